"""I-Match fingerprints, in DataFrame functions only.

The lexicon holds the terms of a band of document frequency (so of inverse
document frequency), counted over all documents.  A text's distinct lexicon
terms, sorted, are hashed once for each of several random lexicon subsets of
different density: dense subsets tell exact copies, sparse ones still agree
when parts of a text differ.

Terms are 18-bit hashes.  The lexicon so becomes a table of one bit a slot: one
value of 37 KB whatever the corpus is, a scalar subquery that each row looks up
in place, so that neither the lexicon nor the terms of a text are ever joined or
shuffled, and no plan holds it as a literal.  At ``LOW`` times the corpus as the
least frequency of a lexicon term, rare terms that share a slot don't lift it
into the band: were even a tenth of 200 terms a document rare, a slot would get
a share of 20 / 2**18 of the documents, far less than ``LOW``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SLOTS = 1 << 18
#: Slots in a byte of the table: 7, so that each byte is an ASCII character.
PACKED = 7
#: The band: least and greatest share of the documents that hold a term.
LOW, HIGH = 0.001, 0.1
#: Families of lexicon subsets: (shared, own, subsets).  Bits of a term's hash
#: decide: in each family the shared bits are 0, the own ones name the subset,
#: so that one in 2 ** (shared + own) terms belongs to it.  Each family has bits
#: of its own; besides these subsets there is the whole lexicon.
FAMILIES = ((1, 0, 1), (2, 0, 1), (3, 0, 1), (3, 1, 2), (3, 2, 4), (3, 3, 6), (4, 3, 8), (5, 3, 6), (7, 2, 4))
#: Average rows of a block in which documents meet their next one.
BLOCK_ROWS = 4096
#: Quantiles of doc_id, a power of 2, between which blocks are cut evenly.
MAX_CUTS = 4096
#: Blocks up to which their first ids, 8 bytes each, are broadcast.
MOST_BROADCAST = 1_000_000


def slots(text: Column) -> Column:
    """Slots of the distinct terms (runs of letters and digits, lower-cased) of a text."""
    terms = F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")
    return F.array_distinct(F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(SLOTS)).cast("int")))


def lexicon(texts: DataFrame) -> bytes:
    """One bit a slot: set if it is in the band, over all rows of ``texts`` (text)."""
    counted = texts.select(F.explode(slots(F.col("text"))).alias("slot")).groupBy("slot").count()
    n = texts.count()
    band = counted.filter((F.col("count") >= max(2.0, LOW * n)) & (F.col("count") <= max(2.0, HIGH * n)))
    table = bytearray(SLOTS // PACKED + 1)
    for r in band.select("slot").collect():  # at most SLOTS numbers, whatever the corpus is
        table[r["slot"] // PACKED] |= 1 << r["slot"] % PACKED
    return bytes(table)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _with_bits(hashes: Column, at: int, width: int, value: int) -> Column:
    mask = F.lit(((1 << width) - 1) << at)
    return F.filter(hashes, lambda x: x.bitwiseAND(mask) == F.lit(value << at))


def _split(at: int, width: int, subsets: int, hashes: Column) -> Column:
    return F.array(*(_with_bits(hashes, at, width, k) for k in range(subsets)))


def prints(text: Column, lex: Column) -> Column:
    """A hash for each lexicon subset; null where a subset has no term of the text."""
    return _once(lex, lambda x: _prints(text, x))  # taken out of the row once, not for each term


def _prints(text: Column, lex: Column) -> Column:
    byte = lambda s: F.ascii(F.substring(lex, F.floor(s / PACKED).cast("int") + 1, F.lit(1)).cast("string"))
    known = F.filter(slots(text), lambda s: F.getbit(byte(s), s % PACKED) == 1)

    def chosen(terms: Column) -> Column:
        parts, at = [F.array(terms)], 0
        for shared, own, subsets in FAMILIES:
            first = _with_bits(terms, at, shared, 0)
            at += shared
            if own:
                parts.append(_once(first, partial(_split, at, own, subsets)))
            else:
                parts.append(F.array(first))
            at += own
        return F.concat(*parts)

    subsets = _once(F.sort_array(F.transform(known, lambda s: F.xxhash64(s))), chosen)
    return F.transform(subsets, lambda c: F.when(F.size(c) > 0, F.xxhash64(c)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that have terms in either text."""
    live = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda z: z))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda z: z))
    return F.when(live > 0, same / live)


def fingerprint(hashes: Column, text: Column) -> Column:
    """The hashes as text; the text's own digest if it has no lexicon term."""
    some = F.exists(hashes, lambda x: x.isNotNull())
    parts = F.transform(hashes, lambda x: F.coalesce(F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, 32))), 8, "0"), F.lit("--------")))
    return F.when(some, F.array_join(parts, "")).otherwise(F.concat(F.lit("sha256:"), F.sha2(text, 256)))


def _block(edges: Column, at: Column, each: int) -> Column:
    """Number of the block of an id: the last edge not above it, by halving; ``each`` even parts up to the next edge."""
    steps = F.array(*(F.lit(MAX_CUTS >> k) for k in range(MAX_CUTS.bit_length())))
    further = lambda i, k: F.when((i + k <= F.size(edges)) & (F.element_at(edges, F.least(i + k, F.size(edges))) <= at), i + k).otherwise(i)

    def inside(i: Column) -> Column:
        low, high = F.element_at(edges, i), F.coalesce(F.get(edges, i), F.element_at(edges, -1) + 1)
        part = F.floor((at - low) * each / F.greatest(high - low, F.lit(1)))
        return i.cast("long") * each + F.least(F.greatest(part, F.lit(0)), F.lit(each - 1))

    return _once(F.greatest(F.aggregate(steps, F.lit(0), further), F.lit(1)), inside)


def with_next(rows: DataFrame, columns: tuple[str, ...], derive) -> DataFrame:
    """``rows`` with ``next_<c>`` of the row with the next smaller doc_id, the first after the last.

    Rows (doc_id, text, h) are dealt to blocks by ranges of doc_id; besides its
    rows each block gets the first row of the next one.  So every text moves
    once, and no task orders all rows.  ``derive`` adds the columns to rows.
    """
    bare = rows
    ids = rows.select("doc_id")
    n = ids.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    cuts = min(MAX_CUTS, blocks)
    edges = ids.approxQuantile("doc_id", [i / cuts for i in range(cuts + 1)], 0.1 / cuts) if n else []
    if edges:
        edges = sorted({int(e) for e in edges})
        each = -(-blocks // cuts)
        table = rows.sparkSession.createDataFrame([(edges,)], "e array<long>").scalar()
        rows = rows.withColumn("edges", table).withColumn("block", _block(F.col("edges"), F.col("doc_id"), each)).drop("edges")
    else:
        rows = rows.withColumn("block", F.lit(0).cast("long"))
    heads = cut(rows.groupBy("block").agg(F.max("doc_id").alias("head")), "heads")  # a row a block
    after = Window.orderBy(F.col("block").desc())
    order = heads.withColumn("to", F.coalesce(F.lead("block").over(after), F.max("block").over(Window.partitionBy())))
    order = order.select("head", F.col("to"), F.col("block").alias("from"))
    # Each head's text goes to the block before its own: the row after that block's last one.
    ahead = order.select(F.col("to").alias("own"), F.col("from").alias("block")).join(heads.select(F.col("block").alias("own"), "head"), "own").select("head", "block")
    ahead = cut(ahead, "ahead")
    marked = F.broadcast(ahead) if blocks <= MOST_BROADCAST else ahead  # so no text moves for this
    first = bare.join(marked, bare.doc_id == F.col("head")).groupBy("block", "doc_id")
    tails = first.agg(F.min_by("text", "h").alias("text"), F.min("h").alias("h")).select("doc_id", "text", "h", "block")
    dealt = derive(rows.select("doc_id", "text", "h", "block")).withColumn("tail", F.lit(0)).unionByName(derive(tails).withColumn("tail", F.lit(1)))
    w = Window.partitionBy("block").orderBy("tail", F.col("doc_id").desc(), "h")
    for c in columns:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(w))
    return dealt.filter("tail = 0").drop("block", "tail")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Result: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  A null text is the empty one.  The edited text ends
    in the first characters of the next document by descending doc_id, the first
    one after the last; of rows that share a doc_id, the order is that of a hash
    of their texts.  Rows without doc_id have no next document: their edited
    text loses its second half, and near_next is 0.  Texts without lexicon terms
    are alike only if they are equal.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lex = docs.sparkSession.createDataFrame([(lexicon(docs),)], "lex binary").scalar()

    def printed(df: DataFrame, column: str, text: str) -> DataFrame:
        # Higher-order functions take no subquery, so it is a column of its own for a moment.
        return df.withColumn("lex", lex).withColumn(column, prints(F.col(text), F.col("lex"))).drop("lex")

    rows = docs.withColumn("h", F.xxhash64("text"))

    def derive(df: DataFrame) -> DataFrame:
        return printed(df, "prints", "text")

    placed = with_next(rows.filter("doc_id is not null"), ("text", "prints"), derive)
    lone = derive(rows.filter("doc_id is null")).withColumns({"next_text": F.lit(None).cast("string"), "next_prints": F.lit(None).cast("array<bigint>")})
    out = placed.unionByName(lone.select(*placed.columns))

    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    out = out.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    out = printed(out, "edited_prints", "edited")
    like = lambda a, b, equal: F.coalesce(likeness(F.col(a), F.col(b)), equal.cast("double"), F.lit(0.0))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("prints"), F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited_prints"), F.col("edited")).alias("edited_fingerprint"),
        like("prints", "edited_prints", F.col("text") == F.col("edited")).alias("near_edited"),
        like("prints", "next_prints", F.col("text") == F.col("next_text")).alias("near_next"),
    )
