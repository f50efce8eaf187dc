"""Order MinHash: fingerprints of texts that tell how little they were edited.

A text is a sequence of symbols (words), its k-mers are numbered by
occurrence, and every permutation of the numbered k-mers picks the few least
ones; these are read in TEXT order and hashed as a tuple. Two texts agree in
such a tuple only if they share the k-mers and their order, so the share of
equal tuples falls with the edit distance, where plain MinHash sees only sets.

The permutations are the orders of ``hash XOR probe`` with probes that differ
in their leading bits. So the numbered k-mers are hashed and sorted once, and
each permutation's least ones are among the first few of every range of equal
leading bits. All of it is Spark SQL on arrays within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.llm.order import positions

#: Symbols of a k-mer, k-mers of a tuple, leading bits (2 ** BITS tuples a fingerprint).
KMER, TUPLE, BITS = 2, 2, 5
#: Of 64 bits, the lower ones hold a k-mer's place in the text.
PLACE_BITS = 28
_PLACE = (1 << PLACE_BITS) - 1
_SIGN = -(1 << 63)
#: A symbol: up to 16 characters between white space, or any one character from U+0E00 on,
#: where the scripts written without blanks begin.
SYMBOL = r"[\x21-\u0DFF\x00-\x08\x0E-\x1F]{1,16}|[\u0E00-\x{10FFFF}]"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _up_to(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _kmers(symbols: Column) -> Column:
    """Hashes of all k-mers, in text order; fewer symbols than one are one k-mer, none are none."""
    n = F.size(symbols)
    count = F.greatest(n - (KMER - 1), F.least(n, F.lit(1)))
    return F.transform(_up_to(count), lambda i: F.xxhash64(*(F.get(symbols, i + j) for j in range(KMER))))


def _first_of(ordered: Column, at: Column) -> Column:
    """Place of the first entry with the leading bits of ``ordered[at]``, by binary search."""
    high = _long(~_PLACE)
    want = F.get(ordered, at).bitwiseAND(high)

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(ordered, mid).bitwiseAND(high) < want
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(
            F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi")))
    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(at))),
                       F.struct(F.lit(0).alias("lo"), at.cast("int").alias("hi")), halve, lambda s: s["lo"])


def _numbered(kmers: Column) -> Column:
    """Every k-mer with its occurrence number, hashed; the lower bits hold its place in the text."""
    high, low = _long(~_PLACE), _long(_PLACE)
    ordered = F.sort_array(F.transform(kmers, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("bigint"))))

    def number(all_: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            def other(back: int) -> Column:  # the entry so far before is of another k-mer, or there is none
                return (i < back) | (F.get(all_, i - back).bitwiseAND(high) != x.bitwiseAND(high))
            nth = F.when(other(1), 1).when(other(2), 2).when(other(3), 3).otherwise(i - _first_of(all_, i) + 1)
            return F.xxhash64(x.bitwiseAND(high), nth).bitwiseAND(high).bitwiseOR(x.bitwiseAND(low))
        return F.transform(all_, one)
    return _let(ordered, number)


def fingerprint(text: Column) -> Column:
    """2 ** BITS numbers below 2 ** 16, one a tuple; equal texts have equal ones.

    The numbers of a text without symbols are those of an empty tuple, a text
    with fewer k-mers than a tuple takes has one tuple of all of them. Null is
    an empty text.
    """
    shift = 64 - BITS

    def least(values: Column) -> Column:  # the first few of each range of leading bits
        return F.filter(values, lambda x, i: (i < TUPLE) | (
            F.shiftrightunsigned(F.get(values, i - TUPLE), shift) != F.shiftrightunsigned(x, shift)))

    def tuples(kmers: Column) -> Column:
        def told(picked: Column) -> Column:
            def one(probe: Column) -> Column:
                chosen = F.slice(F.sort_array(F.transform(picked, lambda x: x.bitwiseXOR(probe))), 1, TUPLE)
                places = F.sort_array(F.transform(chosen, lambda y: y.bitwiseAND(_long(_PLACE))))
                found = F.transform(places, lambda p: F.get(kmers, p.cast("int")))
                return F.xxhash64(found).bitwiseAND(_long(0xFFFF)).cast("int")
            # the flipped sign makes Spark's signed order that of unsigned numbers
            probes = F.array(*(_long(((j << shift) ^ (1 << 63)) - (1 << 64 if (j << shift) ^ (1 << 63) >= 1 << 63 else 0))
                               for j in range(1 << BITS)))
            return F.transform(probes, one)
        return _let(_let(F.sort_array(_numbered(kmers)), least), told)

    symbols = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SYMBOL), F.lit(0))
    return _let(_let(symbols, _kmers), tuples)


def likeness(one: Column, other: Column) -> Column:
    """Share of equal tuples, 0 to 1."""
    return F.aggregate(F.zip_with(one, other, lambda a, b: (a == b).cast("int")), F.lit(0),
                       lambda s, x: s + x) / F.lit(float(1 << BITS))


def as_text(prints: Column) -> Column:
    """A fingerprint as hex digits, four a tuple."""
    return F.array_join(F.transform(prints, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def with_next(docs: DataFrame, head_chars: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its fingerprint, and the beginning and fingerprint of the next one.

    Returns ``id_col``, text (null: empty), fingerprint, head (the first
    ``head_chars`` code points of the next text; an expression over ``size``,
    the document's own code points) and next_fingerprint. Documents ascend by
    id, null first, those of one id by a hash of their text; the last one's
    next is the first. Rows that agree in id and text are one document and get
    the same row. A single document is its own next; an empty table stays
    empty; other columns aren't looked at.

    Ids, sizes and hashes alone are ranked. Texts move once, by their own key;
    only beginnings and fingerprints move on to the document before.
    """
    base = (docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
            .withColumn("hash", F.xxhash64("text")))
    keys = base.groupBy("id", "hash").agg(F.max(F.char_length("text")).alias("size"))
    ranked = positions(keys, ["id", "hash"], None, "next")
    after = ranked.select(F.col("pos").alias("at"), F.col("id").alias("next_id"), F.col("hash").alias("next_hash"))
    links = (ranked.withColumn("at", (F.col("pos") + 1) % F.col("n")).join(after, "at")
             .select(F.col("id").alias("own_id"), F.col("hash").alias("own_hash"), head_chars.alias("wanted"),
                     "next_id", "next_hash"))
    printed = base.withColumn("fingerprint", fingerprint(F.col("text")))

    def same(a: str, b: str) -> Column:
        return F.col("id").eqNullSafe(F.col(a)) & (F.col("hash") == F.col(b))

    heads = (printed.join(links, same("next_id", "next_hash"))
             .select("own_id", "own_hash", F.col("text").substr(F.lit(1), F.col("wanted")).alias("head"),
                     F.col("fingerprint").alias("next_fingerprint"))
             .groupBy("own_id", "own_hash").agg(F.first("head").alias("head"),
                                                F.first("next_fingerprint").alias("next_fingerprint")))
    return (printed.join(heads, same("own_id", "own_hash"))
            .select(F.col("id").alias(id_col), "text", "fingerprint", "head", "next_fingerprint"))
