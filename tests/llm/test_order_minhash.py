import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from breaklens.llm.order_minhash import BITS, KMER, PLACE_BITS, TUPLE, as_text, fingerprint, likeness, with_next
from breaklens.llm.queries import op11_order_minhash

LOW = (1 << PLACE_BITS) - 1


class Small(int):
    """A 32-bit number."""


def hashed(*values):
    """Spark's xxhash64 of columns."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(4 if isinstance(v, Small) else 8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def plain(text):
    """The fingerprint, by sorting all numbered k-mers for every permutation."""
    symbols = re.findall(r"[\x21-෿\x00-\x08\x0E-\x1F]{1,16}|[฀-\U0010FFFF]", text or "")
    kmers = [hashed(*symbols[i:i + KMER]) for i in range(max(len(symbols) - KMER + 1, min(len(symbols), 1)))]
    seen, values = {}, []
    for i, k in enumerate(kmers):
        top = k & ~LOW
        seen[top] = seen.get(top, 0) + 1
        signed = top - (1 << 64) if top >> 63 else top
        values.append(hashed(signed, Small(seen[top])) & ~LOW | i)
    out = []
    for j in range(1 << BITS):
        least = sorted(values, key=lambda v: v ^ j << (64 - BITS))[:TUPLE]
        out.append(hashed(*(kmers[p] - (1 << 64) if kmers[p] >> 63 else kmers[p] for p in sorted(v & LOW for v in least)))
                   & 0xFFFF if least else 42 & 0xFFFF)
    return out


def texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    some = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 5, 30, 200, 1500)]
    return some + [None, "", " \n\t", "one", "日本語のテキスト", "la " * 300, "x" * 1000, "a\U0001F600b é\x00z", "mixed 日本 text"]


def test_fingerprint_equals_plain_order_minhash(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = spark.createDataFrame(rows, "i int, t string").select("i", fingerprint(F.col("t")).alias("f")).collect()
    for r in got:
        assert list(r.f) == plain(rows[r.i][1]), rows[r.i][1]


def test_order_and_repetition_count(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    shuffled = words[:]
    rng.shuffle(shuffled)
    pairs = {"same": " ".join(words), "shuffled": " ".join(shuffled), "halves swapped": " ".join(words[200:] + words[:200]),
             "one edit": " ".join(["new", *words[1:]]), "twice": " ".join(words * 2)}
    rows = [(k, " ".join(words), v) for k, v in pairs.items()]
    got = {r.k: r.x for r in spark.createDataFrame(rows, "k string, a string, b string").select(
        "k", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("x")).collect()}
    assert got["same"] == 1 and got["one edit"] > 0.9 and got["shuffled"] < 0.1
    assert got["twice"] < 0.6  # plain MinHash would say 1
    assert got["halves swapped"] < 0.8  # nearly all k-mers are shared; tuples across the cut are in another order


def test_query_equals_brute_force(spark, tmp_path, make, write_prose):
    rows = [(i * 3, write_prose(n % 40)) for i, n in enumerate(range(60))]
    rows += [(500, None), (501, ""), (502, "abc"), (503, "ÄÖ 日本 é\U0001F600 x" * 9), (None, "no id"), (700, "tie"), (700, "tie"),
             (800, rows[5][1]), (801, "la la la " * 50)]
    make(rows, extra=True).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_order_minhash(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    order = sorted(set((d is not None, d or 0, t or "") for d, t in rows))  # no two texts share an id here
    hexed = lambda f: "".join(f"{x:04x}" for x in f)
    share = lambda a, b: sum(x == y for x, y in zip(a, b)) / len(a)
    want = {}
    for (known, d, t), (_, _, after) in zip(order, order[1:] + order[:1]):
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        a, b, c = plain(t), plain(edited), plain(after)
        want[d if known else None] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b),
                                      share(a, b), share(a, c))
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


def test_single_empty_and_tied_ids(spark, make):
    quarter = F.col("size")
    assert with_next(make([]), quarter).count() == 0
    (one,) = with_next(make([(1, "alone here")]), quarter).collect()
    assert one.head == "alone here" and one.fingerprint == one.next_fingerprint
    tied = with_next(make([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (None, "d"), (None, None)]), quarter).collect()
    assert len(tied) == 6 and {r.head for r in tied} <= {"a", "b", "c", "d", ""}
    assert len({(r.doc_id, r.text, r.head) for r in tied}) == 5


def test_text_form(spark):
    (r,) = spark.range(1).select(as_text(F.array(F.lit(1), F.lit(0xABCD)))).collect()
    assert r[0] == "0001abcd"
