"""A job: named inputs, a build step and the schemas of its outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from civicflow.session import applied
from civicflow.sources.manifest import Publication
from civicflow.sources.publish import conform, parse_ddl, untyped, write_output
from civicflow.sources.shapes import BINARY_COLUMN, scan_geometry, unreadable_geometry
from civicflow.sources.tables import DatasetRef, Staging, read_csv_text, read_versioned

Frames = dict[str, DataFrame]
Share = Callable[[DataFrame, str], DataFrame]


def as_is(df: DataFrame, label: str) -> DataFrame:
    """Leave a frame that several outputs are cut from as it is."""
    return df


@dataclass(frozen=True)
class JobSpec:
    """``build`` takes the inputs by name and gives the outputs by name.

    ``outputs`` maps an output to its schema.  Outputs in ``keep_empty`` publish
    empty text as it is; all others publish it as NULL.  A build step that cuts
    several outputs from one frame takes a second argument, ``share``, through
    which it passes that frame; publishing writes the frame once there.  Inputs
    in ``late`` come to the build step with their binary geometry unread.
    """

    name: str
    inputs: list[str]
    outputs: dict[str, str]
    build: Callable[..., Frames]
    keep_empty: frozenset[str] = field(default_factory=frozenset)
    shares: bool = False
    late: frozenset[str] = field(default_factory=frozenset)

    def run(self, inputs: Frames) -> Frames:
        """Build and conform every output; nothing is computed yet.

        Binary geometry of an input is read on the way (S4).
        """
        missing = [name for name in self.inputs if name not in inputs]
        if missing:
            raise ValueError(f"{self.name} needs {missing}")
        built = self.build(self._scanned(inputs))
        return {name: conform(built[name], ddl, name not in self.keep_empty) for name, ddl in self.outputs.items()}

    def _scanned(self, inputs: Frames) -> Frames:
        return {name: df if name in self.late else scan_geometry(df) for name, df in inputs.items()}

    def publish(
        self,
        spark: SparkSession,
        base_in: str,
        base_out: str,
        versions: dict[str, str] | None = None,
        csv: dict[str, str] | None = None,
        unreadable: dict[str, dict[str, int]] | None = None,
    ) -> dict[str, str]:
        """Read the inputs, run, and write every output under the base folder, visible together at the end.

        ``versions`` names the version of an input or output where it is not
        ``latest``.  Inputs named in ``csv``, such as corrections, are read from
        a CSV file, with a ``line`` that grows with its lines.  ``unreadable``
        is filled with the number of values of each output's columns that their
        type could not hold, and of binary geometry of each input that cannot be
        read.  The library's session settings hold meanwhile.
        """
        versions, csv = versions or {}, csv or {}

        def ref(name: str) -> DatasetRef:
            return DatasetRef(name, versions.get(name, "latest"))

        with applied(spark), Staging(spark, base_out) as staging:
            inputs = {
                name: read_csv_text(spark, csv[name], line="line", multi_line=True)
                if name in csv
                else read_versioned(spark, ref(name), base_in)
                for name in self.inputs
            }
            if unreadable is not None:
                shapes = {name: unreadable_geometry(df) for name, df in inputs.items() if BINARY_COLUMN in df.columns}
                unreadable.update({name: {BINARY_COLUMN: n} for name, n in shapes.items()})
            inputs = self._scanned(inputs)
            built = self.build(inputs, share=staging.keep) if self.shares else self.build(inputs)
            paths = {}
            with Publication(spark, base_out, self.name) as publication:
                for name, ddl in self.outputs.items():
                    counts = None if unreadable is None else unreadable.setdefault(name, {})
                    frame, null = built[name], name not in self.keep_empty
                    frame = frame if null else untyped(frame, parse_ddl(ddl))
                    paths[name] = write_output(publication, frame, ref(name), ddl, null, counts)
            return paths
