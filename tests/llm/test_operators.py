"""Each operator against a plain version of it, on small texts with every odd case."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import boosting, byte_pairs, decontaminate, jaccard, language, licenses, neighbours, personal, quality, registry, scoring, sharding, text as X

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
LONG = "lorem ipsum dolor sit amet " * 30_000

#: Nulls, empty and blank texts, one letter, a very long text, other scripts, ties and repeated rows.
ODD = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, None), (3, ""), (4, " \n\t "), (5, "a"), (6, LONG), (7, "日本語のテキスト 🎉 ÀÉ"), (1, "The quick brown fox jumps over the lazy dog again and again"), (None, "the QUICK brown fox, jumps over the lazy dog. Again and again!"), (8, "x\x00y\x0bz"), (9, "a" * 5000)]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    """With further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "k", 1, [1.0], "b", 2, 3) for i, t in ODD], "doc_id long, text string, key string, uid int, x array<double>, base string, node int, block int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# --- words ---------------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    import pyarrow as pa

    texts = [t for _, t in ODD]
    w = X.Words(*X.utf8(pa.array(texts)), X.LETTERS)
    plain = [words(t) for t in texts]
    assert w.count.tolist() == [len(p) for p in plain]
    flat = [x for p in plain for x in p]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == flat
    hashes = w.hashes().tolist()
    assert len(set(hashes)) == len(set(flat)) == len(set(zip(hashes, flat)))


def test_slices_keep_every_row():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in range(50)])], names=["text"]).slice(3, 40)
    assert [t for s in X.slices([batch], "text", 100) for t in s.column(0).to_pylist()] == batch.column(0).to_pylist()


# --- 1 decontamination ---------------------------------------------------------------------------------------------


def plain_hits(text, items, window=10):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        m = min(window, len(v))
        wins = {tuple(v[s : s + m]) for s in range(len(v) - m + 1)} if m else set()
        for s in range(len(w) - m + 1 if m else 0):
            if tuple(w[s : s + m]) in wins:
                hit.update(range(s, s + m))
                found.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, odd):
    r = random.Random(1)
    vocabulary = [r.choice(["a", "b", "the", "fox", "é", "7"]) for _ in range(4)]
    items = [(1, "brown fox jumps over the lazy dog again and AGAIN"), (2, "lazy dog"), (2, "lazy dog"), (3, None), (4, ""), (None, "dolor"), (10, " ".join(r.choice(vocabulary) for _ in range(30)))]
    more = [(100 + k, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 300)))) for k in range(40)]
    docs = odd.select("doc_id", "text", "key", "uid").unionByName(spark.createDataFrame([(*m, "k", 1) for m in more], "doc_id long, text string, key string, uid int"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    want = [(i, *plain_hits(t, items)) for i, t in [*ODD, *more]]
    assert sorted(map(repr, (tuple(x) for x in got))) == sorted(map(repr, want))
    kept = {x["doc_id"] for x in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == {w[0] for w in want if w[2] == 0}


def test_decontamination_in_groups(spark, odd, monkeypatch):
    monkeypatch.setattr(decontaminate, "GROUP", 1)
    items = [(1, "brown fox jumps over the lazy dog again and again"), (2, "quick brown"), (3, "over the lazy")]
    got = decontaminate.contamination(odd, spark.createDataFrame(items, "item_id long, text string")).filter("key = 1").first()
    assert tuple(got)[1:] == plain_hits(ODD[0][1], items)


def test_decontamination_of_nothing(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, none).count() == 0
    assert decontaminate.contamination(odd, none).filter("n_hit > 0").count() == 0


# --- 2 personal data -----------------------------------------------------------------------------------------------

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and personal.luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    r = random.Random(5)
    for _ in range(8000):
        t = "".join(r.choice("ab.@@-+%0123456789 ().-12é") for _ in range(r.randint(0, 60)))
        assert personal.base_spans(t) == plain_spans(t), t
    for t in ("call +1 (212) 555-0100 or mail a.b@c.org", "4111 1111 1111 1111", "1.2.3.4.5", "999.1.1.1", "a@b@c.de", "x@y.z@w.v"):
        assert personal.base_spans(t) == plain_spans(t)


def test_added_spans():
    add = lambda t: [s for s in personal.find([t], *personal.model())[0][1] if s not in personal.base_spans(t)]
    assert add("please phone 212-555-0100 today") == [("phone", 13, 25)]
    assert add("mail: jane [at] example [dot] org") == [("email", 6, 33)]
    for clean in ("version 10.20.300.4000 of 2024", "order 2024 0815 1234", "page 12 of 300, 1,000,000 words", "", "no numbers here"):
        assert add(clean) == []


def test_added_hosts_and_groups():
    model = personal.model()
    add = lambda t: [(s[0], t[s[1] : s[2]]) for s in personal.find([t], *model)[0][1] if s not in personal.base_spans(t)]
    for address in ("2001:db8::8a2e:370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1", "2a02:26f0::"):
        assert add(f"the server {address} answered") == [("ip", address)]
        assert personal.groups_fit(address)
    assert add("see http://[2001:db8::1]:8080/x and 2001:db8::2/64") == [("ip", "2001:db8::1"), ("ip", "2001:db8::2")]
    assert add("mail root@localhost about it") == [("email", "root@localhost")]
    assert add("write to jane.doe@mailhost, please") == [("email", "jane.doe@mailhost")]
    for clean in ("at 12:30:45 sharp", "mac address 00:1a:2b:3c:4d:5e here", "std::add(x) and Abc::face()", "take a[1::2] or a[::2]", "install react@18 or left@latest", "2:1:3 ratio", "a :: b", ":::::", "@ home @work", "C = A@B"):
        assert add(clean) == []
    for bad in ("1:2:3:4:5:6:7", "1::2::3", "12345::1", "::", "1:2:3:4:5:6:7:8:9", ":1::2", "1::2:", ":::1", "1:2:3:4:5:6:7:8::"):
        assert not personal.groups_fit(bad)


def test_added_spans_in_any_case_and_beside_long_ones():
    model = personal.model()
    for t in ("mail: jane [At] example [dot] org", "mail: jane [aT] example [Dot] org"):
        assert personal.find([t], *model)[0][1] == [("email", 6, 33)]
    taken = [(0, 100), *((k, k + 1) for k in range(10, 60, 10))]
    reach = [100] * len(taken)
    assert personal._overlaps(taken, reach, ("phone", 70, 80)) and not personal._overlaps(taken, reach, ("phone", 100, 110))
    numbers = "_".join(f"1.2.3.{k}" for k in range(10))
    text = f"x{numbers}_phone_212-555-0100@example.org"
    base, every = personal.find([text], *model)[0]
    assert ("email", 0, len(text)) in base and base == every


@pytest.mark.parametrize("text", ["1:" * 200_000, "a:::" * 50_000, "x::a" * 50_000, "a@" * 100_000, "a@b-" * 50_000, "::1 " * 20_000, "fe80::1 " * 20_000, "root@localhost " * 12_000])
def test_further_spans_in_linear_time(text):
    import time

    model = personal.model()
    began = time.time()
    personal.find([text], *model)
    assert time.time() - began < 5


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "+1" + "(" * 200_000, "@a" * 80_000, "1.2.3." * 40_000, "a." * 80_000 + "@", "+ " * 100_000, "- " * 100_000, "1 " * 100_000])
def test_spans_in_linear_time(text):
    import time

    began = time.time()
    personal.find([text], *personal.model())
    assert time.time() - began < 5


def test_redaction(spark, odd):
    t = "a mail x@y.org, +49 30 1234567 and 10.0.0.1!"
    assert personal.redacted(t, personal.base_spans(t)) == "a mail [EMAIL], [PHONE] and [IP]!"
    assert personal.redacted("abcdef", [("card", 1, 3), ("phone", 2, 5)]) == "a[CARD]f"
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    got = personal.redact(docs.unionByName(docs.filter("doc_id = 5").withColumn("text", F.lit("x@y.org").cast("string"))))
    assert got.schema == docs.schema and got.filter("text = '[EMAIL]' AND n_chars = 7").count() == 1
    assert personal.find_personal(odd).count() == len(ODD)


# --- 3 sharding ----------------------------------------------------------------------------------------------------


def check_shards(got, n):
    assert (got.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s))))).all()
    sizes = got.groupby("shard")["size"].sum().reindex(range(n), fill_value=0)
    return sizes


def test_shards(spark):
    r = random.Random(2)
    rows = [(k, "".join(r.choice("abcdé") for _ in range(r.randint(0, 300)))) for k in range(2000)] + [(5000 + k, "the same text everywhere") for k in range(1500)] + [(7, "twin row")] * 300 + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(docs, shards=6).toPandas()
    sizes = check_shards(got, 6)
    assert len(got) == len(rows) and sizes.max() - sizes.min() < 0.05 * sizes.mean()
    parts = docs.join(sharding.assign(docs, shards=6).select(F.col("key").alias("doc_id"), "shard"), "doc_id").filter("doc_id < 2000").groupBy("text").agg(F.countDistinct("shard").alias("n"))
    assert parts.filter("n > 1").count() <= 5


def test_shards_beside_columns_of_any_type(spark, tmp_path):
    import zlib

    rows = [(k, "x" * (k % 9) if k % 5 else None) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"uid": F.create_map(F.lit("a"), F.lit(1)), "hash": F.lit("h"), "shard": F.lit(9)})
    got = {x["key"]: x for x in sharding.assign(docs, shards=3).collect()}
    for k, t in rows:
        data = (t or "").encode()
        assert (got[k]["size"], got[k]["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
    # equal texts of small groups are together, and what comes before in the line comes before in the shards
    assert len({x["shard"] for x in got.values()}) == 3
    sharding.write_shards(docs, f"file://{tmp_path}/shards", shards=3)
    assert spark.read.parquet(f"file://{tmp_path}/shards").filter("uid['a'] = 1").count() == 200


def test_shards_of_odd_texts(odd, empty, tmp_path, spark):
    got = sharding.assign(odd, shards=4).toPandas()
    check_shards(got, 4)
    assert len(got) == len(ODD) and got["size"].sum() == sum(len((t or "").encode()) + 8 for _, t in ODD)
    assert sharding.assign(empty).count() == 0
    sharding.write_shards(odd.select("doc_id", "text"), f"file://{tmp_path}/shards", shards=3)
    assert sorted(repr(tuple(x)) for x in spark.read.parquet(f"file://{tmp_path}/shards").select("doc_id", "text").collect()) == sorted(map(repr, ODD))


# --- 4 scores ------------------------------------------------------------------------------------------------------


def plain_scores(texts, alpha=0.4, order=2):
    from collections import Counter

    docs = [words(t) for t in texts]
    grams = lambda d, n: Counter(tuple(d[k : k + n]) for k in range(len(d) - n + 1))
    every = [sum((grams(d, n) for d in docs), Counter()) for n in range(1, order + 1)]
    total, out = sum(map(len, docs)), []
    for d in docs:
        own = [grams(d, n) for n in range(1, order + 1)]
        left = lambda g: every[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        rest, s, off = max(1, total - len(d)), 0, 0
        for k, w in enumerate(d):
            longest = min(order, k + 1)
            known = [n for n in range(longest, 0, -1) if left(tuple(d[k - n + 1 : k + 1])) > 0]
            off += not known or known[0] < order
            n = known[0] if known else 0
            p = alpha**longest / rest if not n else alpha ** (longest - 1) * left((w,)) / rest if n == 1 else alpha ** (longest - n) * left(tuple(d[k - n + 1 : k + 1])) / left(tuple(d[k - n + 1 : k]))
            s += int(np.rint(np.log(p) * 1e6))
        out.append((len(d), off, s))
    return out


def test_scores(spark, odd, empty):
    r = random.Random(4)
    more = [(100 + k, " ".join(r.choice(["a", "b", "c", "de", "Fg"]) for _ in range(r.randint(0, 40)))) for k in range(60)]
    docs = odd.select("doc_id", "text", "block").unionByName(spark.createDataFrame([(*m, 0) for m in more], "doc_id long, text string, block int"))
    got = sorted(repr(tuple(x)) for x in scoring.score(docs).collect())
    assert got == sorted(repr((i, *s)) for (i, _), s in zip([*ODD, *more], plain_scores([t for _, t in [*ODD, *more]])))
    assert scoring.score(empty).count() == 0


@pytest.mark.parametrize("order", [1, 3, 4])
def test_scores_of_other_orders(spark, order):
    r = random.Random(14)
    rows = [(k, " ".join(r.choice(["a", "b", "c"]) for _ in range(r.randint(0, 30)))) for k in range(40)]
    got = sorted(tuple(x) for x in scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), order=order).collect())
    want = sorted((i, *s) for (i, _), s in zip(rows, plain_scores([t for _, t in rows], order=order)))
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) <= 50 for a, b in zip(got, want))


def test_scores_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(scoring, "REPEATED", 5)
    rows = [(1, "the same row")] * 300 + [(2, "the other row"), (3, None)]
    got = sorted(tuple(x) for x in scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i, *s) for (i, _), s in zip(rows, plain_scores([t for _, t in rows])))


def test_packing():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        v = np.sort(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (scoring._unpack_sorted(scoring._pack_sorted(v)) == v).all()
        c = r.integers(0, 70_000, n)
        assert (scoring._unpack(scoring._pack(c)) == c).all()


# --- 5 byte pairs --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return byte_pairs.Encoder(byte_pairs.read_vocabulary(public_tokenizers.path(byte_pairs.VOCABULARY)), public_tokenizers.PATTERN)


def test_tokens_are_those_of_the_library(spark, odd, encoder):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "ab", " the", "\n", "\x1c", "\x85", "é", "ß", "0", "!", "'s", chr(r.randrange(0x20, 0xD800))]) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for t in [*texts, "a" * 20_000, "ab" * 9000, "thehe" * 3000, " " * 3000, "<|endoftext|>"]:
        ids = encoder.encode(t)
        assert ids == library.encode_ordinary(t) and encoder.decode(ids) == t.encode()
    for row in byte_pairs.tokenize(odd).collect():
        t = bytes(row["decoded"]).decode()
        assert list(row["ids"]) == library.encode_ordinary(t)
    assert sorted(bytes(x["decoded"]) for x in byte_pairs.tokenize(odd).collect()) == sorted((t or "").encode() for _, t in ODD)


def test_memory_of_tokens(encoder, monkeypatch):
    monkeypatch.setattr(encoder, "remembered", 3)
    encoder.seen.clear()
    text = " ".join(f"w{k % 11}x" for k in range(200))
    assert encoder.decode(encoder.encode(text)) == text.encode() and len(encoder.seen) <= 3


def test_append_ids(odd, empty):
    docs = odd.withColumn("token_ids", F.lit(1))
    got = byte_pairs.append_ids(docs)
    assert got.columns == [*docs.columns, "token_ids_"] and got.count() == len(ODD)
    assert byte_pairs.append_ids(empty).count() == 0


def test_vocabulary_without_bytes():
    with pytest.raises(ValueError, match="no tokens"):
        byte_pairs.Encoder(base64.b64encode(b"a") + b" 0", ".")


# --- 6 neighbours --------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(150, 6)).astype(float)
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(200 + k, base[0].tolist()) for k in range(40)] + [(300 + k, (base[k] * 1e-5).tolist()) for k in range(20)]
    odd = [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (404, [float("nan")] + [1.0] * 5), (405, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (406, [1.0, 2.0]), (407, [2.0, 2.0])]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows + odd], "vec_id long, embedding array<double>, uid int, dim int")
    got = sorted(tuple(x) for x in neighbours.nearest(df, F.col("vec_id") % 7 == 0).collect())
    want = []
    for i, v in rows:
        if i % 7 == 0:
            best = sorted((float(np.sqrt(np.cumsum((np.array(w) - np.array(v)) ** 2)[-1])), j) for j, w in rows if j != i)[:10]
            want += [(i, n, j, d) for n, (d, j) in enumerate(best, 1)]
    assert [x for x in got if x[0] != 406] == sorted(want)
    assert [x for x in got if x[0] == 406] == [(406, 1, 407, 1.0)]


def test_neighbours_with_the_same_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.5]), (1, [3.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in neighbours.nearest(df, F.col("vec_id") == 0).collect())
    assert got == sorted([(0, 1, 0, 0.5), (0, 1, 0, 0.5), (0, 2, 1, 2.0), (0, 2, 1, float(np.sqrt(4.25)))])


def test_bounds_drop_most_pairs(spark, sf_dir):
    path = f"{sf_dir.replace('sf0.001', 'sf0.01')}/embeddings.parquet"
    rows = spark.read.parquet(path).selectExpr("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    assert len(rows) < neighbours.VECTOR_GROUP  # so the query has one group, as here
    asked = np.flatnonzero(ids % 100 == 0)
    found = neighbours.search(x[asked], asked, x, ids, np.arange(len(x)), 10)
    assert found.met == len(asked) * len(x) and found.computed < 0.2 * found.met
    for k, best in zip(asked, found.best()):
        exact = np.sqrt(np.cumsum((x - x[k]) ** 2, axis=1)[:, -1])
        want = sorted((float(d), int(i)) for n, (d, i) in enumerate(zip(exact, ids)) if n != k)[:10]
        assert best == want


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 1e200]), (1, [2.0, -1e200]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert [x["vec_id"] for x in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] in ([2, 1], [1, 2])
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_quantisation_bounds():
    x = np.random.default_rng(2).normal(size=(50, 16)) * 10.0 ** np.arange(-3, 3).repeat(9)[:50, None]
    code, scale, rest = neighbours.quantise(x)
    assert np.allclose(np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1)), rest) and (np.abs(code) <= 127).all()


# --- 7 licences ----------------------------------------------------------------------------------------------------


def test_licence_phrases(spark, odd, empty):
    texts = ["Apache License, apache-license. MIT\nlicense", "the GNU General Public License and GNU GENERAL public  license", "cc by cc by", "gnu general public", None, "", "é mit license é", "licensed mit", "mit", "license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["key"]: x for x in licenses.scan_licenses(docs).collect()}
    for k, t in enumerate(texts):
        w = words(t)
        want = sorted((s, p, v) for p, v in licenses.BASE.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
        assert [(p["start"], p["phrase"], p["label"]) for p in got[k]["places"]] == want and got[k]["n_words"] == len(w)
    assert licenses.scan_licenses(odd).filter("size(places) = 0 AND score = 0").count() == len(ODD) and licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize(
    "text, labels, fine",
    [
        ("MIT", {"mit"}, True), ("GPL-3.0-only OR MIT", {"gpl", "mit"}, True), ("GPL-3.0-only AND MIT", {"gpl", "mit"}, False), ("MIT OR GPL-2.0 AND LGPL-2.1", {"mit", "gpl", "lgpl"}, True),
        ("(MIT OR GPL-2.0) AND LGPL-2.1", {"mit", "gpl", "lgpl"}, False), ("GPL-2.0-or-later WITH Classpath-exception-2.0 OR Apache-2.0", {"gpl", "apache"}, True), ("MIT AND", {"mit"}, False), ("(MIT", {"mit"}, False), ("BSD-3-Clause", {"bsd"}, True),
    ],
)
def test_expressions(text, labels, fine):
    assert licenses.evaluate(text) == (labels, fine)


def test_tags(spark):
    docs = spark.createDataFrame([(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\ncode")], "doc_id long, text string")
    got = licenses.scan_licenses(docs).first()
    assert (got["labels"], got["accepted"], got["score"], got["expressions"]) == (["apache", "gpl", "mit"], True, 1.0, ["(MIT OR GPL-2.0-only) AND Apache-2.0"])


@pytest.mark.parametrize(
    "text, want",
    [
        ("SPDX-License-Identifier: MIT the text goes on", ["MIT"]), ("spdx-license-identifier: MIT and so on, or not", ["MIT"]), ("SPDX-License-Identifier: Apache-2.0 or MIT.", ["Apache-2.0 or MIT"]), ("SPDX-License-Identifier: foo", []),
        ("SPDX-License-Identifier: LicenseRef-Foo.1 AND (Foo-1.0 OR\tISC) x", ["LicenseRef-Foo.1 AND (Foo-1.0 OR\tISC)"]), ("SPDX-License-Identifier: MIT\nAND GPL-2.0", ["MIT"]), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */", ["GPL-2.0-only WITH Classpath-exception-2.0"]),
        ("SPDX-License-Identifier: MIT AND", ["MIT AND"]), ("SPDX-License-Identifier: (MIT", ["(MIT"]), ("a SPDX-License-Identifier:MIT SPDX-License-Identifier: ISC", ["MIT", "ISC"]), ("SPDX-License-Identifier: MIT)", ["MIT"]), ("SPDX-License-Identifier:", []), ("", []),
    ],
)
def test_expressions_end_before_prose(text, want):
    assert licenses.expressions(text) == want


def test_long_tags(spark):
    import time

    long = " AND ".join(["BSD-3-Clause"] * 400 + ["MIT", "GPL-3.0-only"])
    nested = "(MIT AND " * 20_000 + "ISC" + ")" * 20_000
    many = " OR ".join(f"x{k}" for k in range(40_000))
    docs = spark.createDataFrame([(1, f"# SPDX-License-Identifier: {long}\ncode"), (2, f"SPDX-License-Identifier: {nested}"), (3, "SPDX-License-Identifier:" + " " * 100_000)], "doc_id long, text string")
    got = {x["key"]: x for x in licenses.scan_licenses(docs).collect()}
    assert (got[1]["expressions"], got[1]["labels"], got[1]["accepted"]) == ([long], ["bsd", "gpl", "mit"], False)
    assert (got[2]["expressions"], got[2]["labels"], got[2]["accepted"]) == ([nested], ["isc", "mit"], True)
    began = time.time()
    assert licenses.evaluate(many) == ({f"x{k}" for k in range(40_000)}, False)
    assert licenses.expressions("SPDX-License-Identifier: " + "a" * 500_000) == [] and licenses.expressions("SPDX-License-Identifier: " + "a-" * 250_000 + "b") == []
    assert licenses.evaluate(" AND (".join(["MIT", *(f"x{k}" for k in range(40_000))]) + ")" * 40_000)[1] is False
    assert time.time() - began < 5


# --- 8 quality -----------------------------------------------------------------------------------------------------


def test_trees_learn():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = boosting.train(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    assert boosting.train(x[:0], y[:0]).predict(x[:2]).tolist() == [0.5, 0.5]
    assert boosting.train(x[:10], np.ones(10)).predict(x[:1])[0] > 0.9


def test_quality(spark, sf_dir, odd, empty):
    got = registry.QUERIES["op8_boosted_quality"](spark, sf_dir.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    found = got.join(labels, "doc_id").filter("held_out").selectExpr("avg(CAST(predicted = quality AS INT))").first()[0]
    assert found > 0.93
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x["score"] for x in quality.score(odd, quality.fit(odd, none)).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    model = quality.fit(odd, some)
    assert quality.score(odd, model).count() == len(ODD) and quality.score(empty, model).count() == 0


# --- 9 Jaccard join ------------------------------------------------------------------------------------------------


def plain_components(docs, percent=80):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(docs):
        groups.setdefault(find(k), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted((repr((i, len(sets[k]), least[find(k)])) for k, (i, _) in enumerate(docs)))


def edited(r, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("piece, hot, crowd", [(jaccard.PIECE, jaccard.HOT, jaccard.CROWD), (3, jaccard.HOT, jaccard.CROWD), (3, 4, 0), (1, 1, 0)])
def test_components(spark, odd, empty, monkeypatch, piece, hot, crowd):
    for name, value in (("PIECE", piece), ("HOT", hot), ("CROWD", crowd)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(400)}" for _ in range(r.randint(1, 120))) for _ in range(40)]
    chain = texts[0]
    for _ in range(15):
        chain = edited(r, chain, 1)
        texts.append(chain)
    texts += [edited(r, texts[1 + k % 4], r.randint(0, 4)) for k in range(60)] + ["one two", "ONE  two", "one two three four five", "one two three four"]
    shared = " ".join(f"p{k}" for k in range(30))
    texts += [f"{shared} {' '.join(f'q{r.randrange(10**6)}' for _ in range(r.randint(0, 30)))}" for _ in range(40)]
    docs = [*ODD, *((100 + k, t) for k, t in enumerate(texts))]
    df = spark.createDataFrame([(*x, 0, 0) for x in docs], "doc_id long, text string, node int, n int")
    assert sorted(repr(tuple(x)) for x in jaccard.near_duplicates(df).collect()) == plain_components(docs)


@pytest.mark.parametrize("batch", [1, 2, 5, 100])
def test_lists_in_lots_and_pieces(batch):
    """Whatever the batches: single nodes go, repeated rows too, a list in lots keeps all of its nodes."""
    import pyarrow as pa

    r = random.Random(batch)
    rows = sorted((t, lot, place, 10 * t + place, 2 if t % 3 == 0 else 1) for t in range(12) for place in range(r.randint(1, 9)) for lot in [place % 2 if t % 3 == 0 else 0] for _ in range(r.randint(1, 3)))
    given = [pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows[k : k + batch]], pa.int64()) for c in (0, 3, 2, 1, 4)], names=["token", "node", "place", "lot", "lots"]) for k in range(0, len(rows), batch)]
    got = [tuple(x.values()) for b in jaccard._numbered(2)(given) for x in b.to_pylist()]
    want = []
    for t in range(12):
        mine = sorted({x[:4] for x in rows if x[0] == t})
        lots = 2 if t % 3 == 0 else 1
        for lot in range(lots):
            own = [x for x in mine if x[1] == lot]
            want += [(t, x[3], x[2], k // 2 * lots + lot) for k, x in enumerate(own)] if lots > 1 or len(own) > 1 else []
    assert got == want


def test_only_pieces_that_can_hold_links_meet(spark):
    """A list of near copies in one component, with two nodes outside and one of another size, makes no pairs of all its pieces."""
    rows = [(7, 100 + k, 50 << 32, k // 4, 1) for k in range(400)] + [(7, 1, 50 << 32, 100, 1), (7, 2, 50 << 32, 100, 2), (7, 3, 500 << 32, 101, 3)]
    left = spark.createDataFrame(rows, "token long, node long, place long, piece long, label long")
    met = {(x.i, x.j) for x in jaccard.Join(80).meetings(left).collect()}
    assert met == {(k, 100) for k in range(101)}


def near_copies(r, n, words=200):
    """Copies of one text, most with so many words changed that they link with the least changed ones only."""
    base = " ".join(f"b{k}" for k in range(words))
    return [edited(r, base, r.choice([0, 1, 2, 3, 4, 4, 4])) for _ in range(n)]


def test_pairs_of_near_copies_grow_with_their_number(spark, monkeypatch):
    """Nodes that the first round has not linked try their likeliest partners, not all of the group."""
    docs = [(k, t) for k, t in enumerate(near_copies(random.Random(21), 600))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tried, verified = [], jaccard.Join.verified

    def counted(self, pairs, ground, bound):
        tried.append(pairs.count())
        return verified(self, pairs, ground, bound)

    monkeypatch.setattr(jaccard.Join, "verified", counted)
    assert sorted(repr(tuple(x)) for x in jaccard.near_duplicates(df).collect()) == plain_components(docs)
    assert sum(tried[1:]) < 4 * len(docs)


def test_stage_keeps_one_of_many_near_copies(spark, monkeypatch):
    """The stage of the pipeline tries few pairs of a group, too, and keeps the row that names it."""
    import corpus_pipeline

    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate([*near_copies(random.Random(22), 500), "a b c d e f g"])]
    tried, verified = [], jaccard.Join.verified

    def counted(self, pairs, ground, bound):
        tried.append(pairs.count())
        return verified(self, pairs, ground, bound)

    monkeypatch.setattr(jaccard.Join, "verified", counted)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "")
    heads = [i for i, n, c in map(eval, plain_components([x[:2] for x in docs])) if i == c]
    assert sorted(x.doc_id for x in kept.collect()) == sorted(heads)
    assert sum(tried[1:]) < 4 * len(docs)


@pytest.mark.parametrize("forests", [1, 2, 3, 100])
def test_spanning_forests(forests):
    import numpy as np

    r = random.Random(forests)
    for _ in range(20):
        n = r.randint(2, 12)
        edges = r.sample([(a, b) for a in range(n) for b in range(a)], r.randint(1, n * (n - 1) // 2))
        left, want = list(range(len(edges))), set()
        for _ in range(forests):
            group = list(range(n))
            for k in list(left):
                a, b = (group[x] for x in edges[k])
                if a != b:
                    group = [a if g == b else g for g in group]
                    want.add(k)
                    left.remove(k)
        got = jaccard.spanning(*np.array(edges).T, n, forests)
        assert set(np.flatnonzero(got).tolist()) == want


def test_names_that_fall_together(spark, odd):
    r = random.Random(3)
    docs = [*ODD, *((100 + k, " ".join(f"w{r.randrange(90)}" for _ in range(r.randint(1, 60)))) for k in range(60))]
    source = spark.createDataFrame(docs, "key long, text string")
    rows = jaccard.describe(source, jaccard.count_classes(source), 80, 100).withColumn("node", F.col("node").bitwiseAND(F.lit(7)))
    ground = jaccard.Ground(source, jaccard.cut(rows))
    assert ground.renamed == 1 and ground.rows.filter("n > 0").selectExpr("count(DISTINCT node) = count(DISTINCT check)").first()[0]
    assert ground.members.count() == len({frozenset(jaccard.word_shingles(t)) for _, t in docs if t and t.split()})


def test_words_decide():
    join = jaccard.Join(80)
    import pyarrow as pa

    a = " ".join(f"w{k}" for k in range(13))
    pairs = [(a, a), (a, a.upper().replace(" ", "\t")), (a, a + " x"), (a, a + " x y z"), ("one two", "ONE\x0btwo"), ("one", "two")]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(range(6)), pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], names=["x", "y", "text1", "text2"])
    got = [x for b in join._same_words([batch]) for x in b.column(0).to_pylist()]
    assert got == [0, 1, 2, 4]
    assert all(jaccard.word_shingles(t) == {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for t in (a, "a b", "é Ü x y z w") for w in [[x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))]])


def test_unsure_pairs(spark, monkeypatch):
    """With a margin that no pair reaches, every pair of larger sets is decided on words."""
    monkeypatch.setattr(jaccard, "MARGIN", 10**6)
    r = random.Random(12)
    texts = [" ".join(f"w{r.randrange(4000)}" for _ in range(r.randint(90, 160))) for _ in range(12)]
    texts += [edited(r, texts[k % 12], r.randint(0, 5)) for k in range(40)]
    docs = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(repr(tuple(x)) for x in jaccard.near_duplicates(df).collect()) == plain_components(docs)


def test_one_of_each_stays(spark, odd, empty):
    kept = jaccard.keep_one(odd.select("doc_id", "text"))
    assert kept.count() == len(ODD) - 1 and kept.columns == ["doc_id", "text"]
    assert jaccard.keep_one(empty).count() == 0 and jaccard.near_duplicates(empty).count() == 0


def test_filters_agree_with_definition():
    join = jaccard.Join(80)
    for n1 in range(1, 30):
        for n2 in range(n1, 40):
            least = int(join.common(n1 + n2))
            assert all((100 * k >= 80 * (n1 + n2 - k)) == (k >= least) for k in range(n1 + 1))


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_any_number_of_edges(spark, monkeypatch, few):
    from ledgerflow.llm import components as cc

    monkeypatch.setattr(cc, "FEW", few)
    r = random.Random(few)
    edges = [(r.randrange(-90, 90), r.randrange(-90, 90)) for _ in range(80)] + [(k, k + 1) for k in range(1000, 1060)]
    least = {x: x for e in edges for x in e}
    for _ in range(len(least)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = cc.components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(tuple(x) for x in found.collect()) == sorted((k, v) for k, v in least.items() if k != v)
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_a_path(spark):
    from ledgerflow.llm.components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (5, 5)], "u long, v long")
    assert sorted(tuple(x) for x in components(edges).collect()) == [*((k, 0) for k in range(1, 61)), (200, 100)]


# --- 10 language ---------------------------------------------------------------------------------------------------


def plain_phrases(sample, codes):
    """Greedy longest matches, by searching the sample."""
    n = at = 0
    text, piece = "".join(map(chr, sample)), "".join(map(chr, codes))
    while at < len(piece):
        size = 0
        while at + size < len(piece) and piece[at : at + size + 1] in text:
            size += 1
        at += max(1, size)
        n += 1
    return n


@pytest.mark.parametrize("lane", [1, 3, 16])
def test_phrases(monkeypatch, lane):
    monkeypatch.setattr(language, "LANE", lane)
    r = random.Random(6)
    samples = {k: np.array([0 if r.random() < 0.2 else ord(r.choice(a)) for _ in range(200)], np.uint32) for k, a in (("x", "abc"), ("y", "bcd"))}
    model = language.Model(samples)
    texts = ["".join(r.choice("abcd  e1") for _ in range(r.randint(0, 70))) for _ in range(60)] + ["".join(map(chr, samples["x"])).replace("\0", " ") * 2, None, "", "1 2 3", "Ωmega", "𝒳𝒴"]
    size, got = model.phrases(texts)
    for k, t in enumerate(texts):
        folded, _ = language.letters([t])
        codes = model.codes(folded).tolist()
        assert size[k] == len(codes)
        assert got[k].tolist() == [plain_phrases(model.codes(samples[x]).tolist(), codes) for x in ("x", "y")]


def test_language(spark, sf_dir, odd, empty):
    path = sf_dir.replace("sf0.001", "sf0.01")
    got = registry.QUERIES["op10_cross_parsing_language"](spark, path).join(spark.read.parquet(f"{path}/documents.parquet"), "doc_id")
    assert got.filter("held_out").selectExpr("avg(CAST(lang_pred = lang AS INT))").first()[0] > 0.95
    model = language.fit(spark.read.parquet(f"{path}/documents.parquet"))
    said = {(x["key"], x["lang_pred"]) for x in language.identify(odd, model).collect() if x["lang_pred"] == "und"}
    assert said == {(2, "und"), (3, "und"), (4, "und")}
    kept = {x["doc_id"] for x in language.keep_written(spark.read.parquet(f"{path}/documents.parquet"), model).collect()}
    assert len(kept) == spark.read.parquet(f"{path}/documents.parquet").count()
    assert 7 not in {x["doc_id"] for x in language.keep_written(odd, model).collect()}
    unknown = language.fit(empty)
    assert {x["doc_id"] for x in language.keep_written(odd, unknown).collect()} == {1, 5, 6, 7, 8, 9, None}
    assert {x["lang_pred"] for x in language.identify(odd, unknown).collect()} == {"und"} and language.identify(empty, model).count() == 0


def test_pieces_of_whole_texts_are_learned(spark):
    texts = [(1, "1 " * 600 + "abc " * 200, "x"), (2, "zzz " * 100 + "def " * 2000, "y")]
    model = language.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert model.predict(["abc abc abc", "def def def"])[0] == ["x", "y"]


def test_letters_beyond_the_table(monkeypatch):
    monkeypatch.setattr(language, "LANE", 64)
    r = random.Random(9)
    samples = {"han": np.array([0 if r.random() < 0.1 else 0x4E00 + int(300 * r.random() ** 2) for _ in range(3000)], np.uint32), "x": np.array([ord(r.choice("abc ")) for _ in range(300)], np.uint32)}
    samples["x"][samples["x"] == 32] = 0
    model = language.Model(samples)
    texts = ["".join(r.choice(["a", "b", " ", chr(0x4E00 + r.randrange(330)), "д"]) for _ in range(100)) for _ in range(20)] + ["".join(map(chr, samples["han"][50:400])).replace("\0", " ")]
    _, got = model.phrases(texts)
    for k, t in enumerate(texts):
        codes = model.codes(language.letters([t])[0]).tolist()
        assert got[k].tolist() == [plain_phrases(model.codes(samples[x]).tolist(), codes) for x in ("han", "x")]


def test_scripts_that_were_not_learned(spark):
    r = random.Random(10)
    vocabulary = lambda first, many, size, n=800: ["".join(chr(first + r.randrange(many)) for _ in range(r.randint(*size))) for _ in range(n)]
    han, latin = vocabulary(0x4E00, 1800, (1, 3)), vocabulary(97, 26, (2, 8))
    write = lambda v, sign, n=400: sign.join(v[int(len(v) * r.random() ** 2)] for _ in range(n))
    rows = [(k, write(han, ""), "han") for k in range(60)] + [(100 + k, write(latin, " "), "latin") for k in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    new = [write(han, ""), write(latin, " ")]
    other = [write(vocabulary(first, many, (2, 8)), " ") for first, many in ((0x430, 32), (0xE01, 46), (0x627, 20), (0x6E00, 1800))]
    names, _, _ = model.predict(new)
    assert names == ["han", "latin"]
    texts = spark.createDataFrame(list(enumerate(new + other)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in language.keep_written(texts, model).collect()) == [0, 1]


# --- queries and pipeline ------------------------------------------------------------------------------------------


def cells(df):
    return sorted((tuple("" if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(name, spark, sf_dir, duck):
    assert cells(registry.QUERIES[name](spark, sf_dir).toPandas()) == cells(duck.sql(registry.ORACLES[name]).df())


def test_columns_of_queries(spark, sf_dir):
    want = {
        "op2_candidate_boosting": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op3_sampled_splitters": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op5_bitmap_rank_queue": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op7_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op8_boosted_quality": ["doc_id", "held_out", "score", "predicted"],
        "op9_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
        "op10_cross_parsing_language": ["doc_id", "held_out", "lang_pred", "score"],
    }
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, columns in want.items():
        got = registry.QUERIES[name](spark, sf_dir)
        assert got.columns[: len(columns)] == columns and got.count() == n


def test_query_digests(spark, sf_dir, encoder):
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for x in registry.QUERIES["op5_bitmap_rank_queue"](spark, sf_dir).collect():
        ids = encoder.encode(texts[x["doc_id"]])
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[x["doc_id"]].encode()))
    for x in registry.QUERIES["op2_candidate_boosting"](spark, sf_dir).collect():
        base = plain_spans(texts[x["doc_id"]])
        assert x["base_sha256"] == sha(personal.spelled(base).encode()) and x["n_email"] == sum(s[0] == "email" for s in base)
        assert set(personal.spelled(base).split(",")) - {""} <= set(x["spans"].split(","))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    got = C.run(spark, sf_dir).toPandas()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    heads = {i for i, n, c in map(eval, plain_components(docs)) if i == c}
    want = {i for i, t in docs if i in heads and plain_hits(t, items)[1] == 0}
    assert set(got["doc_id"]) == want and len(got) == len(want)
    plain = {i: personal.redacted(t, personal.find([t], *personal.model())[0][1]) for i, t in docs if i in want}
    assert dict(zip(got["doc_id"], got["text"])) == plain and (got["n_tokens"] == got["token_ids"].map(len)).all()
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "decontaminate", "redact", "tokenize"]
