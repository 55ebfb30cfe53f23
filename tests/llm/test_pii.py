"""Personal data against plain regular expressions and a plain count of co-occurrence."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from coloom.llm import pii
from coloom.llm import spans as S

PATTERNS = {"email": pii.EMAIL, "ip": pii.IP, "card": pii.CARD, "phone": pii.PHONE}
WORD = re.compile(pii.WORD)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(PATTERNS[k], text) if good(k, m.group())]


TEXTS = [
    None,
    "",
    "no data here 123 4.5",
    "mail a.b+c@x-y.example.com, b@c.d_e@f.g @x.y a@b",
    "x@y.z.w@q.r 1.2.3.4 256.1.1.1 001.002.003.255 1.2.3.4.5.6.7.8 10.0.0.0001 1.2.3.99999999999999999999",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 378282246310005 12345678901234567890123",
    "call +1 (415) 555-0100 or +49.30.1234567) +1 ((( ++12 345 678 901 +1234",
    "é🎉 a@b.cd 日本 +33 1 23 45 67 89 ü",
    "4111  1111 1111 1111",
    "1" * 30000 + " " + "a" * 30000 + "@b.c",
    "1 2 " * 20000,
    "a.b." * 20000 + "@x" + ".y" * 20000,
    "\n".join(["u@v.wx 10.1.1.1"] * 200),
]


def test_base_spans(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("01.@a+-( )é_4%") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = pii.base_spans(docs).select("doc_id", S.labelled(pii.KINDS, {k: F.col("found")[k] for k in pii.KINDS}).alias("s"))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.s] for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i] == base(t or ""), t


def low_words(s):
    return set(WORD.findall(s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))


def entities(t):
    return {f"{k}:{t[a:b]}" for k, a, b in base(t)}


def slow_risks(texts, limit, z=1.96):
    """{text: {term: instead}} by plain counting over different texts."""
    words = {t: low_words(t) for t in texts}
    held = {t: e for t in words if (e := entities(t))}
    n = len(words)
    kind_of = lambda w: "[number]" if re.search("[0-9]", w) else "[word]"
    kinds = {t: {kind_of(x) for x in w} for t, w in words.items()}

    def tells(c, has):
        n_c = sum(c in e for e in held.values())
        n_t = sum(has(t) for t in words)
        k = sum(has(t) for t, e in held.items() if c in e)
        low = (k + z * z / 2 - z * math.sqrt(k * (n_t - k) / n_t + z * z / 4)) / (n_t + z * z) if n_t else 0.0
        return math.log2(low * n / n_c) >= limit * math.log2(n / n_c) if low > 0 and n_c < n else False

    out = {}
    for t, e in held.items():
        risky = {w for w in words[t] if any(tells(c, lambda x, w=w: w in words[x]) for c in e)}
        hidden = {k: any(tells(c, lambda x, k=k: k in kinds[x]) for c in e) for k in ("[number]", "[word]")}
        out[t] = {w: "" if hidden[kind_of(w)] else kind_of(w) for w in risky}
    return out


def corpus():
    texts = [f"Zorblat wrote from zed@mail.example on day {i} about plan{i}." for i in range(4)]
    texts += [f"item {i} asked zed@mail.example again, ZORBLAT said" for i in range(2)]
    texts += ["Zorblat alone", "the the the"] * 3 + [f"the other {i} text at 10.0.0.{i} with words" for i in range(30)]
    texts += [f"plain {i} words only" for i in range(30)] + ["copy of me@x.yz near Quux"] * 9
    return texts


def many():
    """Random texts: entities and terms in one text and in several, rare numbers, copies."""
    rng = random.Random(11)
    out = []
    for i in range(260):
        t = [rng.choice(["the", "a", "of", "it", "go"]) for _ in range(rng.randint(0, 9))]
        t += [rng.choice(["Kilo", "LIMA", "x7", "é", "日本", "q"]) for _ in range(rng.random() < 0.1)]
        t += [f"only{i}"] * (rng.random() < 0.3) + [f"pair{i // 2}"] * (rng.random() < 0.3)
        if rng.random() < 0.25:
            c = rng.randint(0, 9)
            t += [f"m{c}@x.yz", *[f"near{c}"] * (rng.random() < 0.9), f"10.0.0.{rng.randint(0, 200)}"]
        rng.shuffle(t)
        out.append(" ".join(t))
    return out + out[:40] + [""] * 5


@pytest.mark.parametrize("limit", [0.5, 0.65, 0.8])
@pytest.mark.parametrize("texts", [corpus(), many()])
def test_terms(spark, texts, limit):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id int, text string, base string, k1 int, body int")
    risk = slow_risks(texts, limit)
    assert limit > 0.65 or any(risk.values())
    got = {r.doc_id: [(s.start, s.end, s.instead) for s in r.terms] for r in pii.private_spans(docs.select("doc_id", "text", "k1", "body"), limit=limit).collect()}
    for i, t in enumerate(texts):
        spans, mine = base(t), risk.get(t, {})
        want = [(m.start(), m.end(), mine[m.group().lower()]) for m in WORD.finditer(t) if m.group().lower() in mine and not any(a < m.end() and m.start() < b for _, a, b in spans)]
        assert got[i] == want, t


def test_entity_of_one_text_is_weighed(spark):
    """One text is enough in a large corpus: its own words give it away, common ones and those of other texts do not."""
    texts = ["write me@x.yz about q in the Zorblat case"] + [f"the case of about write {i % 400}" for i in range(4000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("text", F.concat("text", F.lit(" in "), F.monotonically_increasing_id() % 3999))
    clean = [r.text for r in pii.sanitise(docs).collect() if r.text.startswith("write")]
    assert len(clean) == 1 and clean[0].startswith("write [email] about [word] in the [word] case in ")


def test_sanitise(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "write x@y.zz or 10.0.0.1 now", "c"), (3, "write x@y.zz or 10.0.0.1 now", "c"), (None, "clean é text", "d"), (4, "x@1.2.3.4", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string").selectExpr("*", "1 as k1", "2 as base")
    out = sorted(((r.doc_id or 0, r.text) for r in pii.sanitise(docs).collect()), key=str)
    assert pii.sanitise(docs).columns == docs.columns
    assert out == sorted([(1, None), (2, ""), (3, "write [email] or [ip] now"), (3, "write [email] or [ip] now"), (0, "clean é text"), (4, "[email]")], key=str)
    assert pii.sanitise(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in pii.op8_personal_data(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want = base(d.text or "")
        r = got[d.doc_id]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in want) for k in pii.KINDS)


def test_sql_of_terms(spark, tmp_path):
    """The SQL finds the same terms where there are some."""
    import duckdb

    texts = corpus() + many() + [f"word w{i} again" for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in pii.op8_personal_data(spark, str(tmp_path)).select("doc_id", "n_email", "spans").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_email, spans FROM ({pii.sql()})").fetchall())
    assert got == want and any("term:" in r[2] for r in got)


def test_sanitise_clashing_columns(spark):
    row = ("me x@y.zz", 1, 2, 3, 4, "o", "t")
    docs = spark.createDataFrame([row, ("plain", *row[1:]), (None, *row[1:])], "body string, _found int, _k1 int, _k2 int, _terms int, own string, text string")
    got = pii.sanitise(docs, "body")
    assert got.columns == docs.columns
    assert sorted(map(str, (r.body for r in got.collect()))) == ["None", "me [email]", "plain"] and {tuple(r)[1:] for r in got.collect()} == {row[1:]}
