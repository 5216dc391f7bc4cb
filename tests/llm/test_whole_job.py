"""Places where the corpus operators once did less than the whole job."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.llm import near, quality, regions, secrets, substrings
from tests.llm.test_corpus import removed


def test_small_sets_are_linked(spark):
    """Hundreds of pairs of 5 to 60 words at similarities of 0.80 to 0.85, shingles of two words."""
    rng, rows = random.Random(11), []
    sizes = [(c, u) for c in range(4, 59) for u in range(c + 1, 60) if 80 * u <= 100 * c <= 85 * u]
    for k in range(600):
        c, u = sizes[k % len(sizes)] if k % 2 else rng.choice([x for x in sizes if x[0] <= 16])
        w = [f"w{rng.randrange(10**9)}" for _ in range(u + 1)]
        rows += [(2 * k, " ".join(w[: c + 1])), (2 * k + 1, " ".join(w))]
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_repeated_rows_are_scanned_once(spark, tmp_path):
    """Repeated rows and rows without an id have the spans of their own text."""
    a, b = "token=abcdefghijkl0", "x AKIA" + "A" * 16 + " y"
    rows = [(7, a), (7, a), (8, a), (None, a), (None, b), (None, b), (9, b), (10, None), (None, None), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(secrets.OP8_SQL)
    got = secrets.op8_secrets(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    nothing = spark.createDataFrame([], "blob string, rule_version string, spans array<struct<start:bigint,kind:int,end:bigint>>")
    new, found = secrets.scan_history(spark.createDataFrame(rows, "path long, text string"), nothing)
    assert new.count() == 3 and sorted(len(r["spans"]) for r in found.collect()) == [0] * 3 + [1] * 7


def test_every_language_is_judged(spark):
    """Languages of few or no trusted documents, a null one too, take the limits of all trusted documents."""
    rng = random.Random(5)
    words = [w.strip(".,") for w in "the quick brown fox jumps over a lazy dog while seven grey geese fly home across the cold north sea and sing".split()]
    prose = lambda: " ".join(rng.choice(words) for _ in range(60))
    junk = lambda: "".join(rng.choice("#@%qxz~^0&") for _ in range(300))
    rows = [(i, "en", prose()) for i in range(120)] + [(200, "fr", prose()), (201, "fr", junk()), (202, None, junk()), (203, "de", prose()), (204, "de", junk()), (None, "es", junk())]
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(120), 200]] + [(201, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.scores(spark.createDataFrame(rows, "doc_id long, lang string, text string"), labels).collect()
    assert all(r["most_perplexity"] is not None for r in got)
    assert not any(r["kept"] for r in got if r["doc_id"] in (201, 202, 204, None))
    assert sum(r["kept"] for r in got) > 115


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_rows_without_ids_are_cut_by_themselves(spark, hot):
    """Rows that lack a doc_id or repeat one, against brute force over rows in the order of doc_id (none last) and hash."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    some = lambda n: " ".join(word() for _ in range(n))
    shared, twin = some(60), some(50)
    rows = [(1, shared), (2, "x " + shared), (7, twin), (7, twin), (7, "other " + shared), (None, twin), (None, twin + " end"), (None, some(80)), (None, some(80) + shared), (None, None), (7, some(40)), (3, some(90)), (-4, twin + shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = sorted(df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"]))
    brute = removed([(k, (r["text"] or "").encode()) for k, r in enumerate(known)])
    want = [(str(r["doc_id"]), *brute[k]) for k, r in enumerate(known)]
    got = substrings.dedup_substrings(df, hot).collect()
    assert sorted((str(r[0]), *tuple(r[1:5])) for r in got) == sorted(want)


def brute_components(rows, n):
    """Smallest doc_id reachable by links of 0.8, by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("n", "few"), [(2, 50_000), (5, 200)])
def test_groups_of_near_copies(spark, monkeypatch, few, n):
    """Families of one text with edits at random places, families of such copies, and chains, against all pairs."""
    rng, rows = random.Random(17 + n), []
    word = lambda: f"w{rng.randrange(400)}"

    def edited(words, k):
        out = list(words)
        for _ in range(k):
            at = rng.randrange(len(out))
            out[at : at + 1] = rng.choice([[word()], [], [out[at], word()], [out[rng.randrange(len(out))]]])
        return out

    for size in (30, 90):
        base = [word() for _ in range(size)]
        families = [edited(base, size // 6) for _ in range(3)] + [base]
        rows += [edited(rng.choice(families), rng.randrange(0, size // 5)) for _ in range(90)]
        chain = base[:]
        for _ in range(12):
            chain = edited(chain, max(1, size // 30))
            rows.append(chain)
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    monkeypatch.setattr(regions, "PAIRS", few)
    monkeypatch.setattr(regions, "PAIRS_PER_NODE", 0)
    if few == 200:  # regions of more than 40 members are cut again
        monkeypatch.setattr(regions, "WIDE", 8)
        monkeypatch.setattr(regions.linked_components, "__defaults__", (3, 40, None))
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n).collect()}
    assert got == brute_components(rows, n)


def test_texts_that_share_an_id_stay_apart(spark):
    """Different texts of one doc_id are different documents; each joins the component of its own text."""
    rng = random.Random(3)
    a, b, c = (" ".join(f"{x}{rng.randrange(9999)}" for _ in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (2, b + " end"), (5, a), (9, a), (7, c), (None, c), (None, "z y x"), (1, None), (1, " ")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted(
        [("5", "5", True), ("5", "2", False), ("2", "2", True), ("5", "5", True), ("9", "5", False), ("7", "7", True), ("None", "7", False), ("None", "None", True), ("1", "1", True), ("1", "1", True)]
    )


def test_pieces_encode_as_whole_texts(spark):
    """Random texts with white space, marks, digits and added tokens have the ids of the whole text, with any vocabulary."""
    import os

    from corvane.llm import tokens

    rng, path = random.Random(21), tokens.default_vocabulary()
    parts = ["<|endoftext|>", " ", "  ", "\n", "\n\n", "\t", " ", "a", "The", " of", "'s", "12", "345", "é", "ß", "日本", "\U0001f600", ".", ",", "!!", "<|", "|>", "\x1c", "​", "\r\n", "x<|endoftext|>y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    for specials in (True, False):
        e = tokens.Encoder(path, specials)
        assert e.by_piece
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in e.encode(texts)] == want
        assert [[i for p in e.pieces(t) for i in e.ids([p])[0]] for t in texts[:300]] == [[b for i in w for b in i.to_bytes(e.dtype.itemsize, "little")] for w in want[:300]]
    folder = os.path.dirname(path)
    for name in sorted(os.listdir(folder)):
        if name.endswith(".json") and os.path.join(folder, name) != path:
            try:
                e = tokens.Encoder(os.path.join(folder, name), True)
            except Exception:  # not a file of the tokenizers library
                continue
            assert [x.tolist() for x in e.encode(texts[:500])] == [x.ids for x in e.tokenizer.encode_batch(texts[:500], add_special_tokens=False)]


def test_ledger_is_kept(spark, tmp_path, monkeypatch):
    """A second run scans only new blobs; another rule version scans all again; findings reach all paths."""
    path, scanned, scan = f"{tmp_path}/ledger", [], secrets.scan_blobs
    monkeypatch.setattr(secrets, "scan_blobs", lambda blobs, version: scanned.append(blobs.count()) or scan(blobs, version))
    versions = lambda rows: spark.createDataFrame(rows, "path string, text string, blob int")
    a, b = ("x", "token=abcdefghijkl0", 1), ("y", "nothing", 2)
    spans = lambda df: sorted((str(r["path"]), len(r["spans"])) for r in df.collect())
    first = [("x", 1), ("x", 1), ("y", 0)]
    assert spans(secrets.scan_with_ledger(versions([a, a, b]), path)) == first
    assert spans(secrets.scan_with_ledger(versions([a, a, b]), path)) == first
    assert spans(secrets.scan_with_ledger(versions([a, b, ("z", a[1], 0), (None, "AKIA" + "B" * 16, 0)]), path)) == [("None", 1), ("x", 1), ("y", 0), ("z", 1)]
    assert spans(secrets.scan_with_ledger(versions([a]), path, "next")) == [("x", 1)]
    assert scanned == [2, 0, 1, 1]


def test_licenses_against_all_templates(spark):
    """Containment of every template in every window, by sets, for texts that hold templates whole, edited and in part."""
    import re

    from corvane.llm import licenses

    rng, rows = random.Random(6), []
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    some = lambda n: " ".join(rng.choice("alpha beta gamma delta omega licensed under the this work is".split()) for _ in range(n))
    for k in range(240):
        parts = [some(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 2) * rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "changed"
            parts += [" ".join(w[: rng.choice([len(w), len(w), max(1, len(w) - 2), len(w) // 2])]), some(rng.randint(0, 30))]
        rows.append((k, " ".join(parts)))
    rows += [(500, None), (501, ""), (502, "one two"), (None, licenses.TEMPLATES[8][1]), (3, rows[4][1])]
    sh = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    want = set()
    for i, t in rows:
        text = sh(words(t or ""))
        for name, notice in licenses.TEMPLATES:
            wanted = set(sh(words(notice)))
            step = 1 << (len(wanted) - 1).bit_length()
            for a in range(0, len(text), step):
                held = len(wanted & set(text[a : a + 2 * step])) / len(wanted)
                if held >= 0.8:
                    want.add((str(i), name, a, round(held, 9)))
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(str(r["doc_id"]), r["license_id"], r["window"], round(r["containment"], 9)) for r in got} == want and len(want) > 100


def test_texts_are_cut_together():
    """Texts of all ASCII characters and of white space beyond ASCII's, side by side with empty ones, have the ids of the whole text; a piece of many texts is looked up once for all of them."""
    from corvane.llm import tokens

    rng, path = random.Random(33), tokens.default_vocabulary()
    marks = [chr(c) for c in range(128)] + list("\u00e9\u00c9\u00df\u00d7\u00f7\u00f1\u4e2d\u3002\u2019\u201c\u00b2\u0660\u0301\u0085\u00a0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000\ufeff\U0001f600")
    words = ["word", "it's", "I'LL", "x'", "12a", "a,b", "end.", "key=va|ue", "été,", "<|endoftext|>", "<|endoftext", " ", "  ", "\n", " \n ", "\t", "\r\n", "!!", "'s", "%%%"]
    texts = [None, "", " ", "  "] + ["".join(rng.choice(marks if rng.random() < 0.3 else words) for _ in range(rng.randint(0, 12))) for _ in range(8000)]
    texts += [t + x for t in ("word", "", "a.", " ") for x in (" ", "  ", "\n\n", "\t ", " \t") for _ in range(3)] + ["", None]
    for specials in (True, False):
        e = tokens.Encoder(path, specials)
        want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [x.tolist() for x in e.encode(texts)] == want
        assert [x.tolist() for x in e.encode(texts[:4])] == want[:4] and list(e.encode([])) == []

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    e = tokens.Encoder(path, True)
    e.held = Counted()
    line = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    ids = e.tokenizer.encode(line, add_special_tokens=False).ids
    assert all(x.tolist() == ids for x in e.encode([line] * 500))
    assert Counted.asked <= 201  # was one for each piece of each text
