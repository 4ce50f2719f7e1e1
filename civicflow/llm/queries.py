"""One query for each operator on the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm import backoff_lm, byte_bpe, quality_classifier, token_shards, url_filter
from civicflow.llm.components import shared_folder
from civicflow.llm.fill_in_middle import fill_in_middle, restored
from civicflow.llm.html_extraction import extract
from civicflow.llm.line_dedup import without_shared_lines
from civicflow.llm.minhash_dedup import Near, near_duplicates
from civicflow.llm.order_minhash import fingerprints
from civicflow.llm.repetition_rules import Limits, judged
from civicflow.llm.source_mixing import Mix, mixed, n_tokens
from civicflow.llm.spelling_variants import Variants, spelling_variants

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(by))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from."""
    labels = _table(spark, sf_dir, "labels").where(_remainder(F.col("doc_id"), 4) != 2)
    return labels.select("doc_id", F.col("quality").alias("label"))


def op1_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, by a model of the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    scored = quality_classifier.classify(docs, quality_labels(spark, sf_dir))
    return scored.select("doc_id", (_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(_table(spark, sf_dir, "documents"))


#: The production mix: three domains, four languages, equal sources; as many tokens as there are, two epochs at most.
MIX = Mix(
    domains={"src0": "web"} | {f"src{k}": "reference" for k in range(1, 10)},
    domain_weights={"web": 2, "reference": 5, "other": 3},
    lang_weights={"en": 5, "de": 2, "fr": 2, "es": 1},
)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the production mix, one row for each epoch of each."""
    out = mixed(_table(spark, sf_dir, "documents"), MIX, epoch="epoch")
    return out.select("doc_id", "lang", "source", n_tokens(F.col("text")).alias("n_tokens"), "epoch")


def op4_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(_table(spark, sf_dir, "pages"))


def op5_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the model of those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    scored = backoff_lm.scores(docs, _remainder(F.col("doc_id"), 7) != 2)
    return scored.withColumn("held_out", _remainder(F.col("doc_id"), 7) == 2)


def op6_suffix_array_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    out = judged(_table(spark, sf_dir, "documents"), Limits())
    return out.drop("longest_repeat")


def byte_ranks() -> bytes:
    """The rank file of the production tokenizer."""
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to ids and back, as digests."""
    docs, ranks = _table(spark, sf_dir, "documents").select("doc_id", "text"), byte_ranks()
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    both = byte_bpe.decode(encoded, ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's UTF-8 bytes as ids, shuffled over all shards and read back: a digest of each sequence."""
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    token_shards.write_shuffled(_table(spark, sf_dir, "documents"), F.col("text").cast("binary"), path)
    rows = token_shards.read_slots(spark, path)
    return rows.select("slot", "shard", F.sha2("ids", 256).alias("ids_sha256"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, by sets of four-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), Near(width=4, percent=80))


#: Verdicts by host and path.
URL_RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}


def op10_url_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url; the model is trained from urls that the rules decide."""
    pages = _table(spark, sf_dir, "pages")
    url = F.col("url")
    rule = url_filter.rule_of(url_filter.host_of(url), url_filter.path_of(url), URL_RULES)
    label = F.when(rule.isin([r for r, v in URL_RULES.items() if v == "block"]), 1).when(rule.isNotNull(), 0)
    model = url_filter.fit(pages.select("url", label.alias("block")))
    return url_filter.judge(pages, URL_RULES, model)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document made ready for filling in the middle, and its text rebuilt from that, as digests."""
    rows = fill_in_middle(_table(spark, sf_dir, "documents"))
    back = restored(F.col("text"), F.col("form"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("text").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


def op12_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that it shares with a later one, as a digest."""
    rows = without_shared_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_reduced_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, of which every 199th run lost a letter, with their forms and roots."""
    return spelling_variants(_table(spark, sf_dir, "documents"), Variants(noise=199))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_naive_bayes_svm,
        op2_order_minhash,
        op3_source_mixing,
        op4_text_density,
        op5_backoff_automaton,
        op6_suffix_array_rules,
        op7_byte_bpe,
        op8_feistel_shards,
        op9_minhash_near_dedup,
        op10_url_logistic,
        op11_fill_in_middle,
        op12_bloom_lines,
        op13_reduced_alphabet,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _family(level: str, up: str | None, family: list[str], name: str, weight: str) -> str:
    """SQL that shares out the budgets of one level of the tree, as tables {level}_a and {level}."""
    keys = [*family, name]
    of = f"PARTITION BY {', '.join(family)}" if family else ""
    given = "u.budget" if up else f"(SELECT floor(sum(tokens) * {MIX.percent} / 100.0)::BIGINT FROM leaves)"
    join = f"JOIN {up} u ON " + " AND ".join(f"u.{c} IS NOT DISTINCT FROM s.{c}" for c in family) if up else ""
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
        {level}_s AS (SELECT {', '.join(keys)}, sum(tokens) * {MIX.epochs} AS supply, sum(tokens) AS tokens,
            ({weight})::BIGINT AS weight FROM leaves GROUP BY {', '.join(keys)}),
        {level}_g AS (SELECT s.*, {given} AS given FROM {level}_s s {join}),
        {level}_a AS (SELECT *, given - coalesce(sum(supply) OVER w, 0) AS still,
            sum(weight) OVER ({of}) - coalesce(sum(weight) OVER w, 0) AS open_weight FROM {level}_g
            WINDOW w AS ({of} ORDER BY supply::DOUBLE / nullif(weight, 0)::DOUBLE NULLS LAST, {name} NULLS FIRST {before})),
        {level}_f AS (SELECT *, (weight > 0 OR supply = 0)
            AND supply::HUGEINT * open_weight <= weight::HUGEINT * still AS filled FROM {level}_a),
        {level}_r AS (SELECT *, given - coalesce(sum(supply) FILTER (filled) OVER ({of}), 0) AS rest,
            sum(weight) OVER ({of}) - coalesce(sum(weight) FILTER (filled) OVER ({of}), 0) AS rest_weight FROM {level}_f),
        {level} AS (SELECT {', '.join(keys)}, tokens, (CASE WHEN filled THEN supply
            ELSE coalesce(weight * rest // nullif(rest_weight, 0), 0) END)::BIGINT AS budget FROM {level}_r),"""


def _case(column: str, names: dict, other: str) -> str:
    shown = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN {column} = '{k}' THEN {shown(v)}" for k, v in names.items())
    return f"CASE {whens} ELSE {other} END" if names else other


def _mixing_sql() -> str:
    leaf = ["domain", "lang", "source"]
    same = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in leaf)
    return rf"""
        WITH docs AS (SELECT doc_id, lang, source, {_case('source', MIX.domains, "'other'")} AS domain,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
        {_family('one', None, [], 'domain', _case('domain', MIX.domain_weights, '1'))}
        {_family('two', 'one', ['domain'], 'lang', _case('lang', MIX.lang_weights, '1'))}
        {_family('three', 'two', ['domain', 'lang'], 'source', _case('source', MIX.source_weights, '1'))}
        plan AS (SELECT *, coalesce(budget // nullif(tokens, 0), 0) AS epochs FROM three),
        placed AS (SELECT d.*, p.epochs, p.budget - p.epochs * p.tokens AS rest,
            md5('{MIX.seed}:' || p.epochs || ':' || d.doc_id) AS place FROM docs d JOIN plan p ON {same('d', 'p')}),
        summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS through FROM placed),
        copies AS (SELECT *, (epochs + (through <= rest)::INT)::BIGINT AS n FROM summed)
        SELECT doc_id, lang, source, n_tokens, unnest(range(0, n))::INT AS epoch FROM copies"""


def _rules_sql() -> str:
    p = Limits()
    runs = "".join(
        f"""
        all{k} AS (SELECT doc_id, i, ws[i:i + {k - 1}] AS g
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM cut)),
        runs{k} AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM all{k}) WHERE n > 1),
        in{k} AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM runs{k}, range(0, {k}) t(j) GROUP BY doc_id),"""
        for k in sorted({p.window, p.repeat, p.longest + 1})
    )
    return rf"""
        WITH cut AS (SELECT doc_id, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        {runs}
        lines AS (SELECT doc_id, line, count(*) AS n
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM cut)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
        again AS (SELECT doc_id, sum(n - 1) AS n FROM lines GROUP BY doc_id),
        counts AS (SELECT c.doc_id, len(ws)::BIGINT AS n_words,
                coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
                len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                coalesce(again.n, 0)::BIGINT AS n_dup_lines, coalesce(a.n, 0)::BIGINT AS n_repeat_words,
                coalesce(b.n, 0)::BIGINT AS n_covered_words, coalesce(x.n, 0) > 0 AS too_long
            FROM cut c LEFT JOIN again ON again.doc_id = c.doc_id LEFT JOIN in{p.window} a ON a.doc_id = c.doc_id
            LEFT JOIN in{p.repeat} b ON b.doc_id = c.doc_id LEFT JOIN in{p.longest + 1} x ON x.doc_id = c.doc_id),
        failed AS (SELECT *, n_words < {p.least_words} OR 100 * n_repeat_words > {p.window_percent} * n_words AS base_failed
            FROM counts)
        SELECT * EXCLUDE (too_long), NOT base_failed AND NOT too_long
            AND 100 * n_covered_words <= {p.covered_percent} * n_words AS kept FROM failed"""


def _middle_sql() -> str:
    draw = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    return rf"""
        WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
            regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
        drawn AS (SELECT *, len(u) AS n, {draw(0)} % (len(u) + 1) AS a, {draw(1)} % (len(u) + 1) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR {draw(2)} % 100 >= 50 THEN 'plain' WHEN {draw(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
        parts AS (SELECT *, array_to_string(u[:least(a, b)], '') AS p,
            array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s
            FROM drawn)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM parts"""


def _lines_sql() -> str:
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
        WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], {space}), '{_UPPER}', '{_LOWER}') AS k
            FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM cut)),
        shared AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines, count(s.k) FILTER (doc_id <> keeper) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (s.k IS NULL OR doc_id = keeper), '')) AS kept_sha256
        FROM lines l LEFT JOIN shared s ON s.k = l.k GROUP BY doc_id"""


def _variants_sql() -> str:
    byte = "list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)"
    codes = """flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128
        THEN [unicode(ch)] ELSE [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] END))::BIGINT[]"""
    return rf"""
        WITH RECURSIVE crc AS (SELECT list({byte} ORDER BY i) AS t FROM range(256) r(i)),
        runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
            WHERE length(run) >= 6 GROUP BY ALL),
        hashed AS (SELECT run, n, xor(4294967295::BIGINT, list_reduce({codes},
            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS h FROM runs, crc),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0
                THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        shorter AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS d
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        near AS (SELECT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b USING (i, d) WHERE a.word <> b.word
            UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.d
            UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.d),
        best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
        first AS (SELECT b.word, b.n_near, b.top, min(near.other) AS other FROM best b
            JOIN near ON near.word = b.word AND near.n = b.top GROUP BY ALL),
        forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN other END AS form,
            CASE WHEN top >= 5 * w.n THEN top END AS form_n FROM words w LEFT JOIN first f ON f.word = w.word),
        chains AS (SELECT word, word AS root FROM forms
            UNION SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON c.word = f.word
        JOIN forms e ON e.word = c.root AND e.form IS NULL"""


ORACLES: dict[str, str] = {
    "op11_fill_in_middle": _middle_sql(),
    "op12_bloom_lines": _lines_sql(),
    "op13_reduced_alphabet": _variants_sql(),
    "op3_source_mixing": _mixing_sql(),
    "op6_suffix_array_rules": _rules_sql(),
    "op9_minhash_near_dedup": rf"""
        WITH RECURSIVE cut AS (
            SELECT doc_id,
                regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
                ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS g
            FROM cut),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
            WHERE 100 * c >= 80 * (s.n + t.n - c)),
        sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (
            SELECT doc_id AS node, doc_id AS r FROM documents
            UNION SELECT sides.y, reach.r FROM reach JOIN sides ON reach.node = sides.x)
        SELECT d.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(reach.r) AS component_id,
            d.doc_id = min(reach.r) AS kept
        FROM documents d JOIN reach ON reach.node = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
        GROUP BY d.doc_id""",
}
