"""Secret scans with an incremental ledger of blobs.

A blob is a text, addressed by the SHA-256 of its content.  Every version of
every path is a row (path, text); versions with the same content are one blob.
The ledger says which (blob, rule version) pairs have been scanned and what they
held.  A scan

1. groups the versions by content, so a blob is read once however many paths and
   versions have it;
2. takes away the pairs that the ledger has, and matches each remaining blob with
   the rules that are new to it;
3. joins old and new findings back to all paths.

A new rule or a new version of a rule is scanned in old blobs too; old rules only
in new blobs.  All of it is built-in expressions.

A null text is an empty one.  Every row gives a row; repeated rows share their
findings.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coloom.llm import spans as S
from coloom.llm.common import table
from coloom.session import cut


@dataclass(frozen=True)
class Rule:
    """A pattern (as Java and as RE2 read it), and the shortest group or match that counts."""

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0
    #: Java finds the same with fewer tries where matches that are too short need not be found.
    fast: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def keep(self, hit: Column) -> Column:
        if not self.group:
            return F.char_length(hit) >= self.least
        return F.char_length(F.regexp_extract(hit, self.pattern, self.group)) >= self.least

    @property
    def sql(self) -> str:
        if not self.group:
            return f"length(hit) >= {self.least}"
        quoted = self.pattern.replace("'", "''")
        return f"length(regexp_extract(hit, '{quoted}', {self.group})) >= {self.least}"


# The kinds of the contract, in its order.
BASE = [
    Rule(
        "assign",
        1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
        2,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16, fast=r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]+", 32, fast=r"[0-9a-f]{32,}"),
]
# Further kinds, by the public formats of such tokens.
MORE = [
    Rule("private", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", 1, r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
]
RULES = BASE + MORE

FOUND = f"array<struct<rule: string, spans: {S.SPAN}>>"


def scan(
    versions: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: list[Rule] = RULES
) -> tuple[DataFrame, DataFrame]:
    """(versions' other columns, blob, found) and the ledger rows (blob, found) to append.

    found: the rules that have been scanned, each with its spans.
    """
    others = [c for c in versions.columns if c != text_col]
    if "blob" in others or "found" in others:
        raise ValueError("blob and found are columns of the result; select others")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = versions.withColumn("blob", F.sha2(text, 256))
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = named.groupBy("blob").agg(F.first(text).alias("body"))
    if ledger is None:
        todo = blobs.withColumn("todo", names)
    else:
        known = ledger.select("blob", F.explode("found").alias("f")).groupBy("blob").agg(F.collect_set("f.rule").alias("seen"))
        todo = blobs.join(known, "blob", "left").withColumn("todo", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("todo") > 0)
    hits = todo.withColumns({f"hits_{i}": F.when(F.array_contains("todo", r.name), S.matches(F.col("body"), r.fast or r.pattern)) for i, r in enumerate(rules)})
    found = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                S.spans(F.col("body"), r.fast or r.pattern, F.col(f"hits_{i}"), r.keep).alias("spans"),
            )
            for i, r in enumerate(rules)
        ]
    )
    fresh = hits.withColumn("found", found.cast(FOUND)).select(
        "blob", F.filter("found", lambda f: F.array_contains("todo", f["rule"])).alias("found")
    )
    every = fresh if ledger is None else fresh.unionByName(ledger.select("blob", "found"))
    held = (
        every.select("blob", F.filter("found", lambda f: (F.size(f["spans"]) > 0) & F.array_contains(names, f["rule"])).alias("found"))
        .where(F.size("found") > 0)
        .groupBy("blob")
        .agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    )
    joined = named.select(*others, "blob").join(held, "blob", "left")
    return joined.select(*others, "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found")), fresh


def _of(rule: Rule) -> Column:
    return F.flatten(F.transform(F.filter("found", lambda f: f["rule"] == rule.name), lambda f: f["spans"]))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Two scans: one with the rules of the contract, and one after the further rules came, which finds the first in its ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = cut(scan(docs, rules=BASE)[1])
    found, _ = scan(docs, ledger=ledger)
    of = {r.kind: _of(r) for r in RULES}
    kinds = [r.kind for r in RULES]
    return found.select(
        "doc_id",
        *[F.size(of[r.kind]).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(S.written(S.by_start(S.labelled(kinds[: len(BASE)], of))), 256).alias("base_sha256"),
        S.written(S.by_start(S.labelled(kinds, of))).alias("spans"),
    )


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({S.sql_spans("d", [(r.kind, r.pattern, r.sql) for r in RULES])}),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < {len(BASE)}) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
