"""Geocoding as joins against reference tables.

The reference tables stand in for a geocoder:

* points: house, street, borough, zipcode, lon, lat, xy_coord, bbl, bin,
  norm_house, norm_street, is_pending, return_code
* places: house, street, zipcode, lon, lat, bbl, bin
* crossings: street_a, street_b, borough, x, y
* segments and nodes: on_street, from_street, to_street, borough, from_node,
  to_node; node, x, y

A request is what a row asks for: the normalised keys of all its lookups.  The
requests are taken out of the rows, each once however many rows ask for it, and
all their candidate keys meet the union of the books in one narrow join.  What
was found is summed up by request and joined to the rows, which move in that
join only; then the first lookup that hit wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.functions.address import crossing, street_key, stretch
from civicflow.functions.geometry import midpoint, packed_xy, point_wkt_of
from civicflow.functions.numbers import to_number
from civicflow.functions.projection import to_lon_lat
from civicflow.functions.text import blank, col, empty_to_null, is_blank
from civicflow.operators.relate import computed, differs, lookup_spread

# The fields of a geocoding result, in order.
RESULT_FIELDS = [
    "geo_housenum",
    "geo_streetname",
    "geo_bbl",
    "geo_bin",
    "geo_latitude",
    "geo_longitude",
    "geo_xy_coord",
    "geo_x_coord",
    "geo_y_coord",
    "geo_grc",
    "geo_grc2",
    "geo_reason_code",
    "geo_message",
]
# Return codes that count as found, the code of a place outside
# the city, and the names of the lookups.
FOUND_CODES = ["00", "01"]
OUTSIDE_CITY = "71"
BY_ADDRESS = "1B"
BY_PENDING_ADDRESS = "1B-tpad"
BY_PLACE = "AP"
BY_CROSSING = "Intersection"
BY_STRETCH = "Segment"
BY_PACKED = "1E"
BY_HAND = "DCP_Manual"

# What an unsuccessful lookup reports.
NOT_FOUND_CODE = "EE"
NOT_FOUND_MESSAGE = "NOT FOUND"


def _result(**given: Column) -> Column:
    """A result record; fields not given are blank."""
    return F.struct(*[blank(given[f].cast("string")).alias(f) if f in given else F.lit("").alias(f) for f in RESULT_FIELDS])


def _ok(record: Column) -> Column:
    return F.coalesce(record["geo_grc"].isin(*FOUND_CODES), F.lit(False))


def _optional(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def address_book(points: DataFrame, area: str, places: DataFrame | None = None) -> DataFrame:
    """One row by (house, street, area) with a record for each kind of lookup."""
    code = F.coalesce(_optional(points, "return_code", F.lit(None).cast("string")), F.lit("00"))
    record = _result(
        geo_housenum=F.col("house"),
        geo_streetname=F.col("street"),
        geo_bbl=F.col("bbl"),
        geo_bin=F.col("bin"),
        geo_latitude=F.col("lat"),
        geo_longitude=F.col("lon"),
        geo_xy_coord=F.col("xy_coord"),
        geo_grc=code,
        geo_message=F.when(~code.isin(*FOUND_CODES), F.lit(NOT_FOUND_MESSAGE)),
    )
    pending = F.coalesce(F.col("is_pending"), F.lit(False))
    book = points.select(
        F.upper("norm_house").alias("_house"),
        street_key("norm_street").alias("_street"),
        F.upper(area).alias("_area"),
        F.when(pending, F.lit(BY_PENDING_ADDRESS)).otherwise(F.lit(BY_ADDRESS)).alias("_kind"),
        record.alias("_record"),
    )
    if places is not None:
        record = _result(
            geo_housenum=F.col("house"),
            geo_streetname=F.col("street"),
            geo_bbl=F.col("bbl"),
            geo_bin=F.col("bin"),
            geo_latitude=F.col("lat"),
            geo_longitude=F.col("lon"),
            geo_grc=F.lit("00"),
        )
        book = book.unionByName(
            places.select(
                F.upper("house").alias("_house"),
                street_key("street").alias("_street"),
                F.upper(area).alias("_area"),
                F.lit(BY_PLACE).alias("_kind"),
                record.alias("_record"),
            )
        )
    keys = ["_house", "_street", "_area"]
    kinds = [(BY_ADDRESS, "_live"), (BY_PENDING_ADDRESS, "_pending"), (BY_PLACE, "_place")]
    picks = [F.min(F.when(F.col("_kind") == kind, F.col("_record"))).alias(name) for kind, name in kinds]
    return book.dropna(subset=keys).groupBy(*keys).agg(*picks)


def crossing_book(crossings: DataFrame) -> DataFrame:
    """One row by sorted street pair and borough."""
    a, b = street_key("street_a"), street_key("street_b")
    record = _result(geo_x_coord=F.col("x"), geo_y_coord=F.col("y"), geo_grc=F.lit("00"))
    book = crossings.select(
        F.least(a, b).alias("_first"),
        F.greatest(a, b).alias("_second"),
        F.upper("borough").alias("_borough"),
        record.alias("_record"),
    )
    keys = ["_first", "_second", "_borough"]
    return book.dropna(subset=keys).groupBy(*keys).agg(F.min("_record").alias("_crossing"))


def stretch_book(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row by (on, from, to, borough) with the coordinates of both ends."""
    place = nodes.groupBy("node").agg(F.min(F.struct("x", "y")).alias("at"))
    ends = segments.join(place.withColumnsRenamed({"node": "from_node", "at": "from_at"}), "from_node").join(
        place.withColumnsRenamed({"node": "to_node", "at": "to_at"}), "to_node"
    )
    keys = ["_on", "_from", "_to", "_borough"]
    return (
        ends.select(
            street_key("on_street").alias("_on"),
            street_key("from_street").alias("_from"),
            street_key("to_street").alias("_to"),
            F.upper("borough").alias("_borough"),
            F.struct(
                F.col("from_at.x").alias("fx"),
                F.col("from_at.y").alias("fy"),
                F.col("to_at.x").alias("tx"),
                F.col("to_at.y").alias("ty"),
            ).alias("_ends"),
        )
        .dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.min("_ends").alias("_stretch"))
    )


# The lookups of a request: the name of what is found, and how many keys a lookup has at most.
ADDRESS_KEYS = ["_house", "_street", "_area"]
CROSSING_KEYS = ["_first", "_second", "_borough"]
STRETCH_KEYS = ["_on", "_from", "_to", "_borough"]
_KEYS = ["_k0", "_k1", "_k2", "_k3"]


def look_up(rows: DataFrame, books: dict[str, tuple[list[str], DataFrame]]) -> DataFrame:
    """Every row with what each book holds for its keys, NULL where nothing.

    ``books`` has, by name, the key columns of rows and a table of the same
    columns, unique by these, with one or more found columns.  A lookup of which
    a key is NULL finds nothing.
    """
    keys = list(dict.fromkeys(k for names, _ in books.values() for k in names))
    complete = {name: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in names]) for name, (names, _) in books.items()}
    asks = reduce(lambda a, b: a | b, complete.values())
    hashes = [F.when(asks, F.xxhash64(F.lit(seed), *keys)) for seed in (1, 2)]
    asked = computed(rows, {"_request": F.when(asks, F.struct(hashes[0].alias("a"), hashes[1].alias("b")))})
    requests = asked.filter(F.col("_request").isNotNull()).select("_request", *keys).distinct()

    def padded(names: list[str]) -> list[Column]:
        return [F.col(names[i]) if i < len(names) else F.lit("") for i in range(len(_KEYS))]

    def candidate(name: str, names: list[str]) -> Column:
        values = [c.alias(k) for k, c in zip(_KEYS, padded(names))]
        return F.when(complete[name], F.struct(F.lit(name).alias("_book"), *values))

    found = {c: t for names, book in books.values() for c, t in book.dtypes if c not in names}
    candidates = F.array_compact(F.array(*[candidate(name, names) for name, (names, _) in books.items()]))
    wanted = requests.select("_request", F.explode(candidates).alias("c")).select("_request", "c.*")
    shelves = [
        book.select(
            F.lit(name).alias("_book"),
            *[c.alias(k) for k, c in zip(_KEYS, padded(names))],
            *[(F.col(c) if c in book.columns else F.lit(None).cast(t)).alias(c) for c, t in found.items()],
        )
        for name, (names, book) in books.items()
    ]
    met = wanted.join(reduce(DataFrame.unionByName, shelves), ["_book", *_KEYS])
    # A request meets a book once at most, so this only puts its rows together.
    hits = met.groupBy("_request").agg(*[F.max(c).alias(c) for c in found])
    return lookup_spread(asked, hits, ["_request"]).drop("_request")


def _with_pair(df: DataFrame) -> DataFrame:
    """The two streets of a crossing in order, NULL unless both are there."""
    a, b = F.col("_a"), F.col("_b")
    both = a.isNotNull() & b.isNotNull()
    return df.withColumn("_first", F.when(both, F.least(a, b))).withColumn("_second", F.when(both, F.greatest(a, b)))


def _with_result(df: DataFrame, columns: list[str], record: Column, function: Column, extra: list[Column]) -> DataFrame:
    placed = computed(df, {"_result": record, "geo_function": function})
    fields = [F.col(f"_result.{f}").alias(f) for f in RESULT_FIELDS]
    return placed.select(*[F.col(f"`{c}`") for c in columns], *fields, *extra, "geo_function")


def _missed(record: Column) -> Column:
    """What the last lookup reports: its own code, or the general one."""
    return _result(
        geo_grc=F.coalesce(record["geo_grc"], F.lit(NOT_FOUND_CODE)), geo_message=F.lit(NOT_FOUND_MESSAGE)
    )


def geocode(
    df: DataFrame,
    points: DataFrame,
    crossings: DataFrame,
    *,
    house: str,
    street: str,
    area: str,
    places: DataFrame | None = None,
    street_1: str = "streetname_1",
    street_2: str = "streetname_2",
    borough: str = "borough",
) -> DataFrame:
    """Address, pending address, place name, then crossing; first hit wins.

    Adds the result fields and the name of the lookup that hit, blank when none
    did.  ``area`` names the column, here and in the tables, that tells streets
    of one name apart.
    """
    columns = df.columns
    books = {
        "address": (ADDRESS_KEYS, address_book(points, area, places)),
        "crossing": (CROSSING_KEYS, crossing_book(crossings)),
    }
    pair = ~is_blank(street_1)
    keyed = computed(
        df,
        {
            "_house": empty_to_null(F.upper(F.trim(house))),
            "_street": street_key(street),
            "_area": empty_to_null(F.upper(F.trim(area))),
            "_a": F.when(pair, street_key(street_1)),
            "_b": F.when(pair, street_key(street_2)),
            "_borough": F.when(pair, empty_to_null(F.upper(F.trim(borough)))),
        },
    )
    found = look_up(_with_pair(keyed), books)
    live, pending, place, pair = F.col("_live"), F.col("_pending"), F.col("_place"), F.col("_crossing")
    step = F.when(_ok(live), BY_ADDRESS).when(_ok(pending), BY_PENDING_ADDRESS).when(_ok(place), BY_PLACE)
    found = found.withColumn("_step", step)
    record = (
        F.when(F.col("_step") == BY_ADDRESS, live)
        .when(F.col("_step") == BY_PENDING_ADDRESS, pending)
        .when(F.col("_step") == BY_PLACE, place)
        .when(_ok(pair), pair)
        .when(is_blank(street_1), _missed(live))
        .otherwise(_missed(pair))
    )
    function = F.coalesce(F.col("_step"), F.when(_ok(pair), BY_CROSSING), F.lit(""))
    return _with_result(found, columns, record, function, [])


# The ends of a stretch, in state-plane feet.
END_FIELDS = ["geo_from_x_coord", "geo_from_y_coord", "geo_to_x_coord", "geo_to_y_coord"]


def geocode_with_stretch(
    df: DataFrame,
    points: DataFrame,
    segments: DataFrame,
    nodes: DataFrame,
    crossings: DataFrame,
    *,
    house: str = "hnum",
    street: str = "sname",
    borough: str = "borough",
    address: str = "address",
) -> DataFrame:
    """Address, stretch between two streets, then crossing."""
    columns = df.columns
    books = {
        "address": (ADDRESS_KEYS, address_book(points, "borough")),
        "stretch": (STRETCH_KEYS, stretch_book(segments, nodes)),
        "crossing": (CROSSING_KEYS, crossing_book(crossings)),
    }
    keyed = computed(
        df,
        {
            "_house": empty_to_null(F.upper(F.trim(house))),
            "_street": street_key(street),
            "_area": empty_to_null(F.upper(F.trim(borough))),
            "_between": stretch(address),
            "_pair": crossing(address),
        },
    )
    # Street keys are worked out once, ahead of the join that uses them.
    between, pair = F.col("_between"), F.col("_pair")
    keyed = computed(
        keyed,
        {
            "_on": street_key(between["street_1"]),
            "_from": street_key(between["street_2"]),
            "_to": street_key(between["street_3"]),
            "_borough": F.col("_area"),
            "_a": street_key(pair["street_1"]),
            "_b": street_key(pair["street_2"]),
        },
    ).drop("_between", "_pair")
    found = look_up(_with_pair(keyed), books)
    live, ends, hit = F.col("_live"), F.col("_stretch"), F.col("_crossing")
    a, b = F.col("_a"), F.col("_b")
    nothing = F.struct(*[F.lit(None).cast("string").alias(f) for f in RESULT_FIELDS])
    record = (
        F.when(_ok(live), live)
        .when(ends.isNotNull(), nothing)
        .when(_ok(hit), hit)
        .when(a.isNull() | b.isNull(), _missed(live))
        .otherwise(_missed(hit))
    )
    function = (
        F.when(_ok(live), BY_ADDRESS)
        .when(ends.isNotNull(), BY_STRETCH)
        .when(_ok(hit), BY_CROSSING)
        .otherwise("")
    )
    extra = [
        F.col("_stretch.fx").try_cast("double").alias("geo_from_x_coord"),
        F.col("_stretch.fy").try_cast("double").alias("geo_from_y_coord"),
        F.col("_stretch.tx").try_cast("double").alias("geo_to_x_coord"),
        F.col("_stretch.ty").try_cast("double").alias("geo_to_y_coord"),
    ]
    return _with_result(found, columns, record, function, extra)


def drop_outside_city(df: DataFrame) -> DataFrame:
    """Without results outside the city; a missing code stays."""
    return df.filter(differs(F.col("geo_grc"), OUTSIDE_CITY))


def use_manual_position(df: DataFrame, longitude: str = "longitude", latitude: str = "latitude") -> DataFrame:
    """Researched position where the cascade gave none."""
    by_hand = ~is_blank(longitude) & is_blank("geo_x_coord") & is_blank("geo_longitude")
    return (
        df.withColumn("_by_hand", by_hand)
        .withColumn("geo_function", F.when(F.col("_by_hand"), F.lit(BY_HAND)).otherwise(F.col("geo_function")))
        .withColumn("geo_longitude", F.when(F.col("_by_hand"), F.col(longitude)).otherwise(F.col("geo_longitude")))
        .withColumn("geo_latitude", F.when(F.col("_by_hand"), F.col(latitude)).otherwise(F.col("geo_latitude")))
        .drop("_by_hand")
    )


def place_result(df: DataFrame, empty_as_null: bool = True) -> DataFrame:
    """Numeric position, geometry text and address text.

    A crossing is placed by its reprojected coordinates.  The position of a
    manual result is kept in the geometry only.  The address text is NULL when
    a part is missing; ``empty_as_null`` tells whether '' counts as missing.
    """
    part = empty_to_null if empty_as_null else col
    by_crossing = F.col("geo_function") == BY_CROSSING
    df = computed(df, {"_x": to_number("geo_x_coord"), "_y": to_number("geo_y_coord")})
    crossed = to_lon_lat("_x", "_y")
    df = computed(
        df,
        {
            "_lon": F.when(by_crossing, crossed["lon"]).otherwise(to_number("geo_longitude")),
            "_lat": F.when(by_crossing, crossed["lat"]).otherwise(to_number("geo_latitude")),
        },
    )
    by_hand = F.col("geo_function") == BY_HAND

    def number(c: str) -> Column:
        return F.when(~by_hand, to_number(c))

    return computed(
        df,
        {
            "geom": point_wkt_of(F.struct(F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))),
            "geo_address": F.concat(part("geo_housenum"), F.lit(" "), part("geo_streetname")),
            "geo_longitude": number("geo_longitude"),
            "geo_latitude": number("geo_latitude"),
            "geo_x_coord": empty_to_null("geo_x_coord"),
            "geo_y_coord": empty_to_null("geo_y_coord"),
        },
    ).drop("_x", "_y", "_lon", "_lat")


def place_stretch_result(df: DataFrame) -> DataFrame:
    """Geometry of a crossing, a stretch's middle or a packed coordinate."""
    packed = packed_xy(empty_to_null("geo_xy_coord"))
    df = computed(
        df,
        {
            "geo_x_coord": to_number("geo_x_coord"),
            "geo_y_coord": to_number("geo_y_coord"),
            "_lon": to_number("geo_longitude"),
            "_lat": to_number("geo_latitude"),
        },
    )
    direct = F.col("_lon").isNotNull() & F.col("_lat").isNotNull()
    use_packed = (F.col("geo_function") == BY_ADDRESS) & ~direct & empty_to_null("geo_xy_coord").isNotNull()
    df = df.withColumn("geo_function", F.when(use_packed, F.lit(BY_PACKED)).otherwise(F.col("geo_function")))
    # One pair of coordinates to reproject, whichever the lookup gave, and the
    # far end of a stretch.
    function = F.col("geo_function")
    df = computed(
        df,
        {
            "_x": F.when(function == BY_CROSSING, F.col("geo_x_coord"))
            .when(function == BY_STRETCH, F.col("geo_from_x_coord"))
            .when(function == BY_PACKED, packed["x"]),
            "_y": F.when(function == BY_CROSSING, F.col("geo_y_coord"))
            .when(function == BY_STRETCH, F.col("geo_from_y_coord"))
            .when(function == BY_PACKED, packed["y"]),
        },
    )
    near, far = to_lon_lat("_x", "_y"), to_lon_lat("geo_to_x_coord", "geo_to_y_coord")
    middle = midpoint(near["lon"], near["lat"], far["lon"], far["lat"])
    placed = function.isin(BY_CROSSING, BY_PACKED)
    df = computed(
        df,
        {
            c: F.when(placed, near[n]).when(function == BY_STRETCH, middle[n]).otherwise(F.col(c))
            for c, n in [("_lon", "lon"), ("_lat", "lat")]
        },
    )
    point = F.struct(F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))
    return computed(df, {"geom": point_wkt_of(point)}).drop("_x", "_y", "_lon", "_lat")
