"""Sharding by extendible hashing, with DataFrame functions only.

Every row has a string of hash bits: 32 of its key, then 32 of its key and text.  The directory is indexed by a prefix of
them.  A bucket whose rows exceed the byte limit is split on the next bit, and only such a bucket; so a row's shard is the
shortest prefix of its bits whose bucket is within the limit.  Bytes are summed once for each string of bits and then by
prefix, a few bits at a time from the top, for the strings that are still in buckets over the limit: no key is gathered.

Rows that share all bits are equal in key and text (or collide), so bits cannot part them.  If together they are over the
limit they are dealt in turn: ``piece`` numbers the parts, each within the limit where one row is.  A single row over the
limit is a shard of its own.

Defined cases: null keys and null texts hash as the empty string, and a null text has no bytes; an empty table has no
shards; repeated rows are all kept; columns named like the
added ones (shard, depth, n_bytes) are replaced, no others; very long texts are rows like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import cut, unused

BITS = 64
#: Bits by which the directory grows before it is looked at again.
ROUND = 4


def bits_of(text: Column) -> Column:
    """The first 32 bits of an MD5 digest, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def directory(cells: DataFrame, limit: int) -> DataFrame:
    """(bits, depth): how many bits name the shard of each string of 64 bits, from (bits, bytes), a row a string.

    From the top down: a bucket within the limit is a shard, and only the strings of buckets over it go on to the next
    bits, ROUND of them at a time.
    """
    settled, live, depth = None, cells, 0
    while True:
        lo, hi = depth, min(BITS, depth + ROUND)
        # bytes of the finest buckets of this round, and of those above them: as many rows as buckets, not as strings
        fine = live.groupBy(F.expr(f"shiftrightunsigned(bits, {BITS - hi})").alias("fine")).agg(F.sum("bytes").alias("bytes"))
        level = F.explode(F.sequence(F.lit(lo if depth == 0 else lo + 1), F.lit(hi))).alias("depth")
        up = fine.select("fine", "bytes", level).withColumn("above", F.expr(f"shiftrightunsigned(fine, cast({hi} - depth as int))"))
        fits = up.groupBy("depth", "above").agg(F.sum("bytes").alias("sum")).where(F.col("sum") <= limit).select("depth", "above")
        found = up.select("fine", "depth", "above").join(fits, ["depth", "above"]).groupBy("fine").agg(F.min("depth").alias("depth"))
        seen = cut(live.withColumn("fine", F.expr(f"shiftrightunsigned(bits, {BITS - hi})")).join(found, "fine", "left"))
        done = seen.where("depth is not null").select("bits", "depth")
        live, depth = seen.where("depth is null").select("bits", "bytes"), hi
        if hi == BITS:
            done = done.unionByName(live.select("bits", F.lit(BITS).alias("depth")))
        settled = done if settled is None else settled.unionByName(done)
        if hi == BITS or not live.take(1):
            return settled


def shard(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with ``shard`` (the bits of its name, then '.piece' where bits did not suffice), ``depth`` and ``n_bytes``."""
    own = {c: unused(docs, f"shard_{c}") for c in ("bits", "bytes", "depth", "pieces", "place")}  # no column of the rows is touched
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    bits = F.shiftleft(bits_of(k), 32).bitwiseOR(bits_of(F.concat(k, F.lit("|"), F.coalesce(F.col(text), F.lit("")))))
    rows = docs.withColumns({own["bits"]: bits, own["bytes"]: F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")})
    size = F.col(own["bytes"])
    cells = rows.groupBy(F.col(own["bits"]).alias("bits")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"), F.max(size).alias("most"))
    cells = cut(cells)
    names = directory(cells.select("bits", "bytes"), limit)
    # rows alike in all bits and over the limit: as many pieces as the limit asks for, rows dealt by their place
    fair = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("most"), F.lit(1))))
    alike = cells.where((F.col("bytes") > limit) & (F.col("n") > 1)).select("bits", F.ceil(F.col("n") / fair).alias("pieces"))
    names = names.join(alike, "bits", "left").withColumnsRenamed({"bits": own["bits"], "depth": own["depth"], "pieces": own["pieces"]})
    placed = rows.join(names, own["bits"]).withColumn(own["place"], F.monotonically_increasing_id())
    full = F.lpad(F.bin(own["bits"]), BITS, "0")
    piece = F.when(F.col(own["pieces"]) > 1, F.concat(F.lit("."), F.pmod(F.col(own["place"]), F.col(own["pieces"])).cast("string"))).otherwise(F.lit(""))
    name = F.concat(F.substring(full, F.lit(1), F.col(own["depth"])), piece)
    keep = [c for c in docs.columns if c not in ("shard", "depth", "n_bytes")]
    return placed.select(*keep, name.alias("shard"), F.col(own["depth"]).cast("int").alias("depth"), F.col(own["bytes"]).alias("n_bytes"))


def oracle(limit: int) -> str:
    """The same shards of ``documents`` in SQL; rows alike in all bits are taken to fit the limit."""
    return f"""
with rows as (
  select doc_id, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint as high,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 8))::bigint as low, coalesce(strlen(text), 0)::bigint as n_bytes
  from documents),
bits as (select *, lpad(bin(high), 32, '0') || lpad(bin(low), 32, '0') as b from rows),
levels as (select b, depth::int as depth, substr(b, 1, depth::int) as prefix, n_bytes from bits, range(0, 65) as d(depth)),
fits as (select depth, prefix from levels group by depth, prefix having sum(n_bytes) <= {limit}),
named as (select l.b, min(l.depth) as depth from (select distinct b, depth, prefix from levels) l join fits f on l.depth = f.depth and l.prefix = f.prefix group by l.b)
select bits.doc_id, substr(bits.b, 1, coalesce(named.depth, 64)) as shard, coalesce(named.depth, 64)::int as depth, bits.n_bytes
from bits left join named on bits.b = named.b"""
