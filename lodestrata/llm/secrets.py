"""Secret scanning over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds one row for each pair of a
blob and a rule version that has been scanned, with the spans found, also when there are none. An update scans only
pairs that the ledger lacks: new content under all rules, and known content under rules that are new or changed. Findings
are joined back to all paths that hold the blob.

Native: DataFrame operations only. Spans are code points, end exclusive. The positions of all matches come from the
lengths of what a split by the rule leaves between them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import children
from .common import BROADCAST_ROWS, count_kind, fresh_path, joined_spans, salted, written

SPANS = "array<struct<start:bigint,end:bigint>>"
#: Matches of a text that are folded together.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """What to find: matches of pattern whose group has least characters; texts without any of cues are not matched.

    cues are in lower case, and looked for in the lower-cased text; none: every text is matched.
    """

    kind: str
    version: int
    pattern: str
    cues: tuple[str, ...] = ()
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule(
        "assign",
        1,
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        2,
        8,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("akia",), 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
#: Found besides the base kinds: private key headers and signed web tokens.
EXTRA = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("private key-----",)),
    # a header of at most 512 characters, so that a start in a run without a dot is given up after as many
    Rule("jwt", 2, r"eyJ[A-Za-z0-9_-]{8,509}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once: as an element of an array, it is a variable of what use makes."""
    return F.transform(F.array(value), use)[0]


def _positions(text: Column, rule: Rule) -> Column:
    """The spans of rule's matches in text.

    Matches and the gaps before them are folded in blocks of BLOCK, whose begins come from a fold over the blocks' lengths:
    a fold copies what it has gathered at each step, so one over all matches would take a time quadratic in them.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    empty = F.array().cast(SPANS)
    long = lambda n: F.lit(n).cast("long")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        got = F.length(pair["hit"] if not rule.group else F.regexp_extract(pair["hit"], rule.pattern, rule.group))
        kept = F.when(got >= rule.least, F.concat(state["found"], span)).otherwise(state["found"])
        return F.struct(end.cast("long").alias("at"), kept.alias("found"))

    def begins(blocks: Column) -> Column:
        size = lambda block: F.aggregate(block, long(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["hit"]))
        start = F.struct(long(0).alias("at"), F.array().cast("array<bigint>").alias("all"))
        both = lambda s, b: F.struct((s["at"] + size(b)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
        return F.aggregate(blocks, start, both, lambda s: s["all"])

    def spans(blocks: Column) -> Column:
        folded = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("found")), step, lambda s: s["found"])
        return F.flatten(F.zip_with(blocks, begins(blocks), folded))

    def cut(pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda i: F.slice(pairs, i * BLOCK + 1, BLOCK))

    paired = lambda hits: F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    all_spans = lambda hits: _bound(_bound(paired(hits), cut), spans)
    found = _bound(hits, lambda h: F.when(F.size(h) > 0, all_spans(h)).otherwise(empty))
    if not rule.cues:
        return F.when(F.regexp_instr(text, F.lit(rule.pattern)) > 0, found).otherwise(empty)
    lower, cued = F.lower(text), F.lit(False)
    for cue in rule.cues:
        cued = cued | lower.contains(cue)
    return F.when(cued, found).otherwise(empty)


class BlobLedger:
    """The ledger under path: blob binary, rule string (kind@version), spans array<struct<start,end>>; append-only.

    Each update is a folder of its own, which counts once it is written as a whole. Updates are listed from storage, so that
    a ledger that is opened again goes on where it was.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = BASE + EXTRA):
        self.spark, self.rules = spark, rules
        self.path = path or fresh_path(spark, "blob-ledger")
        self.scanned = 0

    def updates(self) -> list[str]:
        names = [n for n in children(self.spark, self.path) if n.startswith("update=")]
        return [f"{self.path}/{n}" for n in names if "_SUCCESS" in children(self.spark, f"{self.path}/{n}")]

    def read(self) -> DataFrame:
        schema, paths = f"blob binary, rule string, spans {SPANS}", self.updates()
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def versions(docs: DataFrame) -> DataFrame:
        """path, blob, text of docs (path, text); a null text is an empty blob."""
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        return docs.select("path", F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))

    def update(self, docs: DataFrame) -> None:
        """Scans the pairs of docs' blobs and the rules' versions that the ledger lacks, each once."""
        versions = self.versions(docs)
        first = versions.groupBy("blob").agg(F.min("path").alias("path"), F.count("*").alias("n"))
        rules = F.array(*[F.lit(r.key) for r in self.rules])
        if self.updates():
            seen = self.read().groupBy("blob").agg(F.collect_set("rule").alias("seen"))
            none = F.array().cast("array<string>")
            todo = first.join(seen, "blob", "left").withColumn("todo", F.array_except(rules, F.coalesce("seen", none)))
        else:
            todo = first.withColumn("todo", rules)
        blobs = written(todo.select("blob", "path", "n", "todo"), "todo")
        todo = blobs.where(F.size("todo") > 0)
        texts = self._texts(versions, blobs, todo, rules)
        found = texts.select(
            "blob",
            F.array(
                *[
                    F.when(
                        F.array_contains("todo", r.key),
                        F.struct(F.lit(r.key).alias("rule"), _positions(F.col("text"), r).alias("spans")),
                    )
                    for r in self.rules
                ]
            ).alias("found"),
        )
        rows = found.select("blob", F.explode(F.filter("found", lambda x: x.isNotNull())).alias("x"))
        rows.select("blob", "x.rule", "x.spans").write.parquet(f"{self.path}/update={uuid.uuid4().hex}")

    def _texts(self, versions: DataFrame, blobs: DataFrame, todo: DataFrame, rules: Column) -> DataFrame:
        """blob, text and todo of one version of each blob in todo. Texts are shuffled only if both what is to be
        scanned and what is to be left out are too many rows to broadcast."""
        full = F.size("todo") == F.size(rules)
        rows, self.scanned, part = blobs.agg(
            F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.size("todo") > 0), F.count_if(~full & (F.size("todo") > 0))
        ).first()
        same = (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p"))
        if self.scanned > BROADCAST_ROWS and not part and rows - self.scanned <= BROADCAST_ROWS:
            shared = blobs.where((F.col("n") > 1) | ~full).select(
                F.col("blob").alias("b"), F.col("path").alias("first"), full.alias("scan")
            )
            others = versions.join(F.broadcast(shared), F.col("blob") == F.col("b")).where(
                ~(F.col("scan") & F.col("path").eqNullSafe(F.col("first")))
            )
            rest = written(others.select("b", F.col("path").alias("p")).distinct(), "known")
            return versions.join(F.broadcast(rest), same, "left_anti").withColumn("todo", rules)
        keys = todo.select(F.col("blob").alias("b"), F.col("path").alias("p"), "todo")
        return versions.join(F.broadcast(keys) if self.scanned <= BROADCAST_ROWS else keys, same)

    def findings(self, docs: DataFrame) -> DataFrame:
        """docs' path with spans: array<struct<kind,start,end>> by start, then rule as listed. No rows of docs, no rows.
        Docs whose blobs no update has scanned, and null and empty texts, have no spans."""
        kinds = F.create_map(*[F.lit(x) for i, r in enumerate(self.rules) for x in (r.key, i)])
        each = self.read().where(F.col("rule").isin([r.key for r in self.rules]) & (F.size("spans") > 0))
        each = each.select("blob", kinds[F.col("rule")].alias("k"), F.explode("spans").alias("s")).distinct()
        names = F.array(*[F.lit(r.kind) for r in self.rules])
        spans = F.transform(
            F.array_sort(F.collect_list(F.struct("s.start", "k", "s.end"))),
            lambda x: F.struct(F.element_at(names, x["k"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
        )
        paths = written(self.versions(docs).select("path", "blob"), "paths")
        times = paths.groupBy("blob").agg(F.count("*").alias("n"))
        by_blob = written(each.groupBy("blob").agg(spans.alias("spans")).join(times, "blob"), "found")
        none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
        return salted(paths, by_blob, "blob", "left").select("path", F.coalesce("spans", none).alias("spans"))


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns of findings (path holds doc_id)."""
    kinds = [r.kind for r in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        F.col("path").alias("doc_id"),
        *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in kinds],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """DuckDB's version: hits and the gaps between them, positions from their summed lengths."""
    parts = []
    for k, r in enumerate(BASE + EXTRA):
        pattern = r.pattern.replace("'", "''")
        got = f"regexp_extract(h[i], '{pattern}', {r.group})"
        parts.append(f"""
  SELECT doc_id, {k} AS k, '{r.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(h) + 1), lambda i: {{
    'a': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0),
    'n': length(h[i]), 'ok': length({got}) >= {r.least}}}), lambda x: x.ok)) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS h, string_split_regex(t, '{pattern}') AS g FROM d)""")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    one = "kind || ':' || s.a::BIGINT || ':' || (s.a + s.n)::BIGINT"
    counts = ",\n  ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg({one}, ',' ORDER BY s.a, k) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg({one}, ',' ORDER BY s.a, k), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


SQL = _sql()
