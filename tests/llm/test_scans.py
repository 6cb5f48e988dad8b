"""License scans, ranked search and fill-in-middle against plain versions, on made-up rows with the odd cases."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodewell.llm import fim, lexical, licenses


def digest(t):
    return hashlib.sha256(t.encode()).hexdigest()


# fill in the middle


def plain_fim(doc_id, text, plain=10, spm=20):
    text = text or ""
    h = digest(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


ALPHABETS = ["ab c\n", "aé", "日本語", "日本ab", "é日😀a<", "😀😁", "<PSM>", "a<P>é"]


@pytest.mark.parametrize("chunk", [3, 64, 1 << 20])
def test_fim(spark, monkeypatch, chunk):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = [None, "", "a", "é", "😀", "<P>", "x<S", "<<M>>", "a<P", "P>b"] + ["".join(rng.choices(a, k=rng.randrange(1, 60))) for a in ALPHABETS * 40]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "some text", "x", 1), (5, "é" * 9, "x", 1), (5, "é" * 9, "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    made = fim.fill_in_middle(d, spm_percent=50)
    got = collections.Counter(tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored()).collect())
    assert got == collections.Counter((i, *plain_fim(i, t, spm=50), t or "") for i, t, _, _ in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}


def test_fim_long_text(spark):
    """A text of several chunks, each begun in the middle of a character's bytes somewhere."""
    t = "".join(chr(0x4E00 + i % 977) if i % 7 else f"é{i} 😀" for i in range(900_000))
    d = spark.createDataFrame([(i, t) for i in range(3)], "doc_id long, text string")
    for r in fim.fill_in_middle(d, plain_percent=0).withColumn("back", fim.restored()).collect():
        assert r.back == t and (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, t, plain=0)


def test_units_of_runs():
    """Events stand only where widths change, and every unit's byte is found from them."""
    text = "plain ascii, " * 50 + "日本語" * 50 + "é" * 30 + " end"
    units = fim.events(fim.SENTINELS).read(text.encode())
    assert len(units.places) == 4 and units.n == len(text)
    assert all(units.byte_of(k) == len(text[:k].encode()) for k in range(len(text) + 1))


@pytest.mark.parametrize("marks", [("<a", "a>", "x"), ("ab", "abc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("é", "b", "c"), ("aba", "c", "d")])
def test_sentinels_that_overlap_are_refused(marks):
    with pytest.raises(ValueError):
        fim.Events(marks)


def test_other_sentinels(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    d = spark.createDataFrame([(i, f"text {i} <P> more é") for i in range(40)] + [(99, "has [mid] in it")], "doc_id string, text string")
    made = fim.fill_in_middle(d, plain_percent=0, sentinels=marks)
    rows = {r.doc_id: r for r in made.withColumn("back", fim.restored(sentinels=marks)).collect()}
    assert rows["99"].form == "plain" and all(rows[str(i)].form != "plain" and rows[str(i)].back == f"text {i} <P> more é" for i in range(40))


# ranked search


def terms(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k):
    held = [(d, collections.Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = 0
            for t in terms(text):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                found.append((-s, d is None, d or 0, d, s))
        out += [(item, i + 1, d, s) for i, (*_, d, s) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return collections.Counter(out)


def made_docs(rng, n):
    words = [f"w{i}" for i in range(40)] + ["Été", "日本", "THE", "the", "x2"]
    docs = [(rng.randrange(-300, 300), " ,;\n"[rng.randrange(4)].join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(1, 40)))) for _ in range(n)]
    docs += [(i, "w1 w2 w3 the") for i in range(1000, 1150)] + [(7, "w1 w2 w3 the")] * 30 + [(None, "w1 w2 w3 the"), (None, "w39 w38"), (3, None), (4, ""), (5, " ,.;\n")]
    return docs


@pytest.mark.parametrize("window, block", [(4096, 1_000_000), (16, 1_000_000), (64, 25)])
def test_search(spark, monkeypatch, window, block):
    """Copies that tie beyond the rank, repeated and negative ids, null keys, windows that overfill, queries in blocks."""
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", block)
    rng = random.Random(window)
    docs = made_docs(rng, 400)
    items = [(1, "w1 w2 the w3"), (2, "w39 Été w38 w39"), (2, "日本"), (3, None), (4, "unheard of"), (5, "!"), (None, "X2 w5 w5 w5"), *((10 + i, " ".join(f"w{rng.randrange(40)}" for _ in range(12))) for i in range(6))]
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, score string, query int").repartition(5)
    q = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    got = collections.Counter(tuple(r) for r in lexical.search(d, q, 7, window=window).collect())
    assert got == plain_search(docs, items, 7)


def test_search_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    q = spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0 and lexical.search(d.where("doc_id = 2"), q).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(d, q).collect()] == [("i", 1, 1)]
    long = spark.createDataFrame([(1, "a b"), (2, "c " * 200_000 + "a")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in lexical.search(long, spark.createDataFrame([("j", "c")], q.schema)).collect()] == [("j", 1, 2)]
    every = spark.createDataFrame([(i, "a") for i in range(600)], d.schema)
    assert lexical.weight(600, 600) == 0 and lexical.search(every, q).count() == 0


# licenses


def test_templates_do_not_hold_each_other():
    sets = {n: set(licenses.words_of(t.encode())) for n, t in licenses.TEMPLATES.items()}
    for a, x in sets.items():
        assert all(a == b or len(x & y) < licenses.needed(len(x), 80) for b, y in sets.items())


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_containment_join(spark, percent):
    rng = random.Random(percent)
    weights = [1 / (i + 1) for i in range(60)]
    templates = {f"t{i}": frozenset(rng.choices(range(60), weights, k=rng.randrange(1, 25))) for i in range(30)}
    blocks = [(i, j, sorted(set(rng.choices(range(60), weights, k=rng.randrange(0, 90))))) for i in range(150) for j in range(3)]
    blocks += [(1000 + i, 0, sorted(x)) for i, x in enumerate(templates.values())]
    got = collections.Counter((r.id, r.block, r.template, r.share) for r in licenses.containment_join(spark.createDataFrame(blocks, "id long, block int, words array<int>"), templates, percent).collect())
    want = collections.Counter((i, j, n, len(t & set(w)) / len(t)) for i, j, w in blocks for n, t in templates.items() if 100 * len(t & set(w)) >= percent * len(t))
    assert got == want and len(want) > 40


def test_scan(spark):
    mit = licenses.TEMPLATES["mit"]
    words = mit.split()
    loose = " ".join(w for i, w in enumerate(words) if i % 9) + " and some words more"
    filler = " ".join(f"filler{i % 313}" for i in range(5000))
    rows = [
        (1, "Released under the MIT-License. The mit\n\nLICENSE mit license mit license"),
        (2, f"{filler} {mit.upper()} {filler}"),
        (3, f"{filler}\n{loose}\n \n{filler}"),
        (4, " ".join(w for i, w in enumerate(words) if i % 3)),
        (5, f"{' '.join(words[:30])}\n\n{' '.join(words[30:])}"),
        (6, "cc by cc by CC-BY 4.0, GNU General Public License"),
        (7, None), (8, ""), (9, " ,;"), (9, "apache\n\n\nlicense"), (None, licenses.TEMPLATES["bsd"] + " " + licenses.TEMPLATES["zlib"]),
    ]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, labels string").repartition(3)
    got = collections.Counter(tuple(r) for r in licenses.scan(d).drop("score").collect())
    n = {2: 10000 + len(licenses.words_of(mit.encode())), 3: 10000 + len(licenses.words_of(loose.encode())), 4: len(licenses.words_of(rows[3][1].encode())), 5: len(licenses.words_of(mit.encode()))}
    both = len(licenses.words_of(rows[-1][1].encode()))
    assert got == collections.Counter([
        (1, 12, 4, 3, 10, "mit", "mit"), (2, n[2], 0, None, None, "", "mit"), (3, n[3], 0, None, None, "", "mit"), (4, n[4], 0, None, None, "", ""), (5, n[5], 0, None, None, "", ""),
        (6, 12, 4, 0, 8, "cc-by,gpl", "cc-by,gpl"), (7, 0, 0, None, None, "", ""), (8, 0, 0, None, None, "", ""), (9, 0, 0, None, None, "", ""), (9, 2, 1, 0, 0, "apache", "apache"), (None, both, 0, None, None, "", "bsd,zlib"),
    ])
    scores = {r.doc_id: r.score for r in licenses.scan(d).where("doc_id IN (1, 2, 3, 4)").collect()}
    assert scores[1] == scores[2] == 1.0 and 0.8 <= scores[3] < 1 and scores[4] == 0.0
    assert licenses.scan(d.limit(0)).count() == 0


def test_every_stretch_lies_in_a_block(spark):
    """A notice is found wherever it begins in a long paragraph."""
    t = licenses.TEMPLATES["zlib"]
    d = spark.createDataFrame([(i, " ".join(f"f{j}" for j in range(i)) + " " + t + " " + " ".join(f"g{j}" for j in range(400 - i))) for i in range(0, 400, 7)], "doc_id long, text string")
    assert licenses.scan(d).where("labels = 'zlib' AND score = 1.0").count() == d.count()


def test_rare_words_only_meet(spark):
    """Blocks of the templates' commonest words alone meet no template."""
    common = [w for w, _ in collections.Counter(w for t in licenses.TEMPLATES.values() for w in set(licenses.words_of(t.encode()))).most_common(25)]
    d = spark.createDataFrame([(i, b" ".join(common).decode()) for i in range(50)], "doc_id long, text string")
    assert licenses.scan(d).where(F.col("labels") != "").count() == 0
