"""Sanitising personal data by what terms disclose.

1. ``base_spans`` finds e-mail addresses, IP addresses, card numbers and phone
   numbers; their values are the protected entities.
2. Every word of a text that holds an entity is a candidate, whatever its length or
   place.  Over the whole corpus, I(c; t) = log2(p(c | t) / p(c)) says how strongly
   term t reveals entity c, and I(c) = -log2 p(c) how much there is to reveal.
   Counts are of different texts, so copies count once.  p(c | t) is the lower end
   of Wilson's interval at ``z`` standard deviations, so that few texts tell little.
3. A term that discloses at least ``limit`` of I(c) for some entity c of a text is
   sanitised in that text: it is generalised to its class ([number] or [word]) if
   the class discloses less than that for all entities of the text, and removed
   otherwise.

Pairs of entity and term are only formed where both are in two texts or more and
could disclose enough; in all other cases they share one text, which decides.
Everything is built-in expressions.  The corpus is split into words once, and only
texts with an entity are looked at word by word.

A null text is empty and stays null.  Every row gives a row; repeated rows and
rows with equal ids are treated alike.  Extra columns, of any name, are kept.  A
long text is many rows of words and one row of spans.  An empty table gives an
empty result, and one without entities has no terms to sanitise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coloom.llm import spans as S
from coloom.llm.common import LOWER, UPPER, content_key, table
from coloom.session import cut

# The patterns of the contract.  The second form matches the same in
# Java without backtracking over long runs: a match starts where a run starts or
# where the last match ended, and no part is given back.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
JAVA = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PHONE,
}
KINDS = ["email", "ip", "card", "phone"]
#: What a word is made of: letters and digits, and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What is counted like a term: every text, and the texts with a word of a class.
ANY, CLASSES = "[any]", ("[number]", "[word]")


def _any(hit: Column) -> Column:
    return F.lit(True)


def _ip(hit: Column) -> Column:
    """No part above 255."""
    return F.forall(
        F.split(hit, r"\."),
        lambda p: (F.char_length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(4)).cast("int") <= 255),
    )


def _card(hit: Column) -> Column:
    """13 to 19 digits that pass Luhn."""
    digits = F.regexp_replace(hit, "[ -]", "")
    n = F.char_length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x)
    return F.when((n >= 13) & (n <= 19), total % 10 == 0).otherwise(False)


def _phone(hit: Column) -> Column:
    n = F.char_length(F.regexp_replace(hit, "[^0-9]", ""))
    return (n >= 9) & (n <= 15)


KEEP = {"email": _any, "ip": _ip, "card": _card, "phone": _phone}


def base_spans(docs: DataFrame, text_col: str = "text", name: str = "found") -> DataFrame:
    """``docs`` with a struct of the spans of each kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = docs.withColumns({f"_hits_{k}": S.matches(text, JAVA[k]) for k in KINDS})
    found = F.struct(*[S.spans(text, JAVA[k], F.col(f"_hits_{k}"), KEEP[k]).alias(k) for k in KINDS])
    return hits.withColumn(name, found).drop(*[f"_hits_{k}" for k in KINDS])


def _of(found: Column) -> dict[str, Column]:
    return {k: found[k] for k in KINDS}


def lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The different words of a text, A-Z lower-cased."""
    return F.array_distinct(F.regexp_extract_all(lower(text), F.lit(WORD), F.lit(0)))


def term_class(term: Column) -> Column:
    return F.when(term.rlike("[0-9]"), "[number]").otherwise("[word]")


def has_class(words: Column, name: str) -> Column:
    return F.exists(words, lambda w: term_class(w) == name)


def with_classes(words: Column) -> Column:
    """The words and, as terms of their own (no word has brackets), what every text is and the classes it has."""

    none = F.array().cast("array<string>")
    return F.concat(words, F.array(F.lit(ANY)), *[F.when(has_class(words, k), F.array(F.lit(k))).otherwise(none) for k in CLASSES])


def certain(n_ct: Column, n_t: Column, z: float) -> Column:
    """The lower end of Wilson's interval for p(c | t), from ``n_ct`` of ``n_t`` texts."""
    middle = n_ct + z * z / 2
    return (middle - z * F.sqrt(n_ct * (n_t - n_ct) / n_t + z * z / 4)) / (n_t + z * z)


def enough(n_c: Column, n: int, limit: float) -> Column:
    """The p(c | t) from which on ``limit`` of I(c) is disclosed."""
    return F.pow(n_c / F.lit(n), F.lit(1 - limit))


def occurrences(held: DataFrame) -> DataFrame:
    """(k1, k2, term, start, end) of all words of the texts ``body``."""
    hits = held.select("k1", "k2", "body", S.matches(F.col("body"), WORD).alias("hits"))
    both = F.slice(F.arrays_zip(F.split("body", WORD, -1).alias("piece"), F.col("hits").alias("hit")), 1, F.size("hits"))
    each = hits.select("k1", "k2", F.posexplode(both).alias("at", "x")).select("k1", "k2", "at", "x.piece", "x.hit")
    so_far = Window.partitionBy("k1", "k2").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.char_length("piece") + F.char_length("hit")).over(so_far).cast("int")
    return each.select("k1", "k2", lower(F.col("hit")).alias("term"), (end - F.char_length("hit")).alias("start"), end.alias("end"))


def disclosing(held: DataFrame, texts: DataFrame, limit: float, z: float) -> DataFrame:
    """(k1, k2, terms): the spans (order, start, end, kind, instead) to sanitise in each different text of ``held``.

    ``held``: (k1, k2, base, body) of the rows with an entity.  ``texts``: (k1, k2,
    text) of the whole corpus.  k1 and k2 stand for the text.
    """
    key = ["k1", "k2"]
    held = held.groupBy(*key).agg(F.first("base").alias("base"), F.first("body").alias("body"))
    held = cut(held.withColumn("words", words(F.col("body"))))
    values = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], S.text_of(F.col("body"), s))))
    mine = held.select(*key, F.explode(with_classes(F.col("words"))).alias("term"))
    # Texts, not arrays of their words, are what is shuffled.
    once = texts.select(*key, "text").dropDuplicates(key).select(words(F.coalesce("text", F.lit(""))).alias("words"))
    every = once.select(F.explode(with_classes(F.col("words"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    counts = cut(every.join(mine.select("term").distinct(), "term", "left_semi"))
    total = {r["term"]: r["n_t"] for r in counts.where(F.col("term").isin(ANY, *CLASSES)).collect()}
    n = total[ANY]

    # Entities: in how many texts, with which classes, and what the classes alone disclose.
    own = [has_class(F.col("words"), k).alias(f"has_{i}") for i, k in enumerate(CLASSES)]
    each = held.select(*key, *own, F.explode(values).alias("entity"))
    known = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"), *[F.count_if(f"has_{i}").alias(f"c_{i}") for i in range(len(CLASSES))])
    tells = [certain(F.col(f"c_{i}"), F.lit(total.get(k, 1)), z) >= enough(F.col("n_c"), n, limit) for i, k in enumerate(CLASSES)]
    each = cut(each.select(*key, "entity").join(known.select("entity", "n_c", *[t.alias(f"tells_{i}") for i, t in enumerate(tells)]), "entity"))
    most = each.agg(F.max("n_c")).first()[0]
    per_text = each.groupBy(*key).agg(F.min("n_c").alias("fewest"), *[F.max(f"tells_{i}").alias(f"tells_{i}") for i in range(len(CLASSES))])

    # Terms that some entity could be disclosed by, at the very most.
    able = certain(F.least("n_t", F.lit(most)), F.col("n_t"), z) >= enough(F.lit(1), n, limit)
    terms = mine.join(counts.where(able & ~F.col("term").isin(ANY, *CLASSES)), "term")
    alone = terms.join(per_text, key).where((F.col("fewest") == 1) | (F.col("n_t") == 1))
    alone = alone.where(certain(F.lit(1), F.col("n_t"), z) >= enough(F.col("fewest"), n, limit)).select(*key, "term")
    pairs = terms.where("n_t > 1").join(each.where("n_c > 1").select(*key, "entity", "n_c"), key)
    pairs = pairs.where(certain(F.least("n_c", "n_t"), F.col("n_t"), z) >= enough(F.col("n_c"), n, limit))
    met = pairs.groupBy("entity", "term", "n_c", "n_t").agg(F.count(F.lit(1)).alias("n_ct"))
    met = met.where(certain(F.col("n_ct"), F.col("n_t"), z) >= enough(F.col("n_c"), n, limit))
    risky = alone.unionByName(pairs.join(met, ["entity", "term"], "left_semi").select(*key, "term")).distinct()

    kind = term_class(F.col("term"))
    hidden = F.when(kind == CLASSES[0], F.col("tells_0")).otherwise(F.col("tells_1"))
    spans = occurrences(held).join(risky, [*key, "term"]).join(per_text, key)
    span = F.struct(F.lit(len(KINDS)).alias("order"), "start", "end", F.lit("term").alias("kind"), F.when(hidden, "").otherwise(kind).alias("instead"))
    return spans.groupBy(*key).agg(F.array_sort(F.collect_list(span)).alias("terms"))


TERMS = "array<struct<order: int, start: int, end: int, kind: string, instead: string>>"


def with_terms(rows: DataFrame, texts: DataFrame, limit: float, z: float) -> tuple[DataFrame, DataFrame]:
    """The rows without an entity, and those with one and ``terms``: the risky terms outside of ``base``.

    ``rows``: (k1, k2, base, body, ..), stored, so that a text is searched for entities once.
    """
    clean, held = rows.where(F.size("base") == 0), rows.where(F.size("base") > 0)
    none = F.array().cast(TERMS)
    if held.isEmpty():  # nothing is protected, so the corpus need not be counted
        return clean, held.withColumn("terms", none)
    risky = disclosing(held.select("k1", "k2", "base", "body"), texts, limit, z)
    found = held.join(risky, ["k1", "k2"], "left").withColumn("terms", F.coalesce("terms", none))
    free = F.filter("terms", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return clean, found.withColumn("terms", free)


def private_spans(docs: DataFrame, text_col: str = "text", limit: float = 0.8, z: float = 1.96) -> DataFrame:
    """``docs`` without its text, with ``base`` and ``terms``: the spans (order, start, end, kind)."""
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.struct(*others).alias("own"), text.alias("text"), *content_key(text))
    base = S.labelled(KINDS, _of(F.col("found")))
    # Stored once, with the text of those rows that have an entity.
    rows = base_spans(whole, "text").select("own", "k1", "k2", base.alias("base"), "text")
    rows = cut(rows.select("own", "k1", "k2", "base", F.when(F.size("base") > 0, F.col("text")).alias("body")))
    clean, held = with_terms(rows, whole.select("k1", "k2", "text"), limit, z)
    out = clean.withColumn("terms", F.array().cast(TERMS)).select("own", "base", "terms").unionByName(held.select("own", "base", "terms"))
    return out.select("own.*", "base", "terms")


def rewrite(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, instead) replaced; of overlapping spans the first counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["instead"].alias("instead"))))

    def step(acc: Column, s: Column) -> Column:
        skip = s["start"] < acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.when(skip, F.greatest(acc["at"], s["end"])).otherwise(s["end"]).alias("at"),
            F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], F.array(gap, s["instead"]))).alias("out"),
        )

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.lit(2147483647)))

    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, finish)


def sanitise(docs: DataFrame, text_col: str = "text", limit: float = 0.8, z: float = 1.96) -> DataFrame:
    """``docs`` with personal data and what reveals it taken out of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The columns of a row go along as one, so none of their names is in the way.
    whole = docs.select(F.struct("*").alias("own"), text.alias("body"), *content_key(text))
    base = S.labelled(KINDS, _of(F.col("found")))
    rows = cut(base_spans(whole, "body").select("own", "k1", "k2", "body", base.alias("base")))
    clean, held = with_terms(rows, rows.select("k1", "k2", F.col("body").alias("text")), limit, z)
    instead = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("instead"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["instead"].alias("instead"))),
    )
    new = held.select("own", rewrite(F.col("body"), instead).alias("new"))
    return clean.select("own.*").unionByName(new.select(F.col("own").withField(f"`{text_col}`", F.col("new")).alias("own")).select("own.*"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    found = private_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    every = F.concat("base", F.transform("terms", lambda s: s.dropFields("instead")))
    return found.select(
        "doc_id",
        *[F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(S.written(F.col("base")), 256).alias("base_sha256"),
        S.written(every).alias("spans"),
    )


_DIGITS = "regexp_replace(hit, '[ -]', '', 'g')"
_WORTH = f"CAST({_DIGITS}[i] AS INTEGER)"
_SQL_KEEP = {
    "email": "TRUE",
    "ip": "list_bool_and(list_transform(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) <= 3"
    " AND coalesce(TRY_CAST(nullif(ltrim(p, '0'), '') AS INTEGER), 0) <= 255))",
    "card": f"""length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
      CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN {_WORTH} WHEN {_WORTH} > 4 THEN 2 * {_WORTH} - 9 ELSE 2 * {_WORTH} END)) % 10 = 0""",
    "phone": "length(regexp_replace(hit, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
}


def _sql_words(text: str) -> str:
    return f"list_distinct(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{WORD}'))"


def _sql_tells(n_ct: str, n_t: str, z: float, limit: float) -> str:
    low = f"({n_ct} + {z * z / 2} - {z} * sqrt({n_ct} * 1.0 * ({n_t} - {n_ct}) / {n_t} + {z * z / 4})) / ({n_t} + {z * z})"
    return f"{low} >= pow(n_c * 1.0 / n, {1 - limit})"


def sql(limit: float = 0.8, z: float = 1.96) -> str:
    kinds = [(k, {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[k], _SQL_KEEP[k]) for k in KINDS]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({S.sql_spans("d", kinds)}),
x AS (SELECT min(rid) AS xid, text FROM d GROUP BY text),
xw AS (SELECT xid, unnest({_sql_words("text")}) AS term FROM x),
terms AS (SELECT term, count(*) AS n_t FROM xw GROUP BY 1),
tot AS (SELECT count(*) AS n FROM x),
ents AS (SELECT DISTINCT xid, kind || ':' || hit AS entity FROM f JOIN x ON xid = rid),
ent AS (SELECT entity, count(*) AS n_c FROM ents GROUP BY 1),
both_ AS (SELECT entity, term, count(*) AS n_ct FROM ents JOIN xw USING (xid) GROUP BY 1, 2),
risk AS (SELECT entity, term FROM both_ JOIN terms USING (term) JOIN ent USING (entity), tot WHERE {_sql_tells("n_ct", "n_t", z, limit)}),
mine AS (SELECT DISTINCT rid, term FROM f JOIN risk ON entity = kind || ':' || hit),
held AS (SELECT rid, text FROM d WHERE rid IN (SELECT rid FROM mine)),
tok AS ({S.sql_spans("held", [("term", WORD, "TRUE")])}),
found AS (SELECT tok.rid, s, e FROM tok JOIN mine ON mine.rid = tok.rid AND mine.term = translate(hit, '{UPPER}', '{LOWER}')
          WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.rid = tok.rid AND f.s < tok.e AND tok.s < f.e)),
every AS (SELECT rid, ord, kind, s, e FROM f UNION ALL SELECT rid, {len(KINDS)}, 'term', s, e FROM found),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (ord < {len(KINDS)}) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) AS spans FROM every GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
