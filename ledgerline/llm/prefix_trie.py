"""Trie of conversation prefixes by chained digests.

A turn is (role, text). The digest of a conversation's first d turns is SHA-256 of the digest of its first d - 1
and of the turn's own digest, so equal digests are equal sequences. Every prefix of every conversation is a row;
rows grouped by (depth, digest) are the trie's nodes. Sums over a subtree explode what a node has to all its
ancestors. These are the prefix rows of the node's smallest conversation, so what its nodes have is first added up
from its last turn towards the root, and each prefix row then carries one number: no more rows than prefixes,
however deep a conversation is.

The chain walks sorted rows as a stream and holds one digest, so a conversation may have any number of turns. The
ids of a node's finished conversations are hashed as a stream as well: joined into pieces where range partitions
end, then piece by piece.

Defined results: rows with null conversation id are left out. Null turns come first, equal turns by their digest. Null role or text
counts as empty. Repeated rows are turns of their own. An empty table has no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise, table

#: Digest of the empty sequence, and of no members.
EMPTY = hashlib.sha256(b"")
#: Most bytes of a piece of joined ids.
PIECE = 1 << 16

#: Fixed values of the query: groups of conversations that share a head, and the most turns of a head plus one.
HEAD_GROUP = 5
HEAD_MODULUS = 9


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, turn_digest, n_bytes): turns numbered from 1, as digest and UTF-8 bytes of the text; no text is shuffled."""
    said, spoken = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    # the role's length keeps role and text apart
    digest = F.unhex(F.sha2(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, spoken), 256))
    thin = (conversations.where(F.col(conv_id).isNotNull())
            .select(F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).alias("turn"), digest.alias("turn_digest"), F.octet_length(spoken).cast("bigint").alias("n_bytes")))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "turn_digest")
    return thin.withColumn("pos", F.row_number().over(order).cast("bigint")).drop("turn")


def head_length(conv: Column) -> Column:
    """Turns a conversation takes from the first of its group: CRC-32 of its decimal id, modulo ``HEAD_MODULUS``."""
    return F.crc32(conv.cast("string")) % HEAD_MODULUS


def with_shared_heads(rows: DataFrame) -> DataFrame:
    """(conv, part, pos, turn_digest, n_bytes): own turns (part 1) of every conversation and the head it takes over (part 0).

    The head is the first turns of conversation c - c % ``HEAD_GROUP``; own turns take its place from there. Own turns that a
    head replaces stay as rows without a digest, which tell that the conversation exists. A turn of a head
    goes to at most 2 * ``HEAD_GROUP`` - 1 conversations, so nothing is joined.
    """
    own = F.struct(F.col("conv").alias("to"), F.lit(1).alias("part"), (F.col("pos") > head_length(F.col("conv"))).alias("counts"))
    heirs = F.filter(F.sequence(F.col("conv") - (HEAD_GROUP - 1), F.col("conv") + (HEAD_GROUP - 1)), lambda c: (c - c % HEAD_GROUP == F.col("conv")) & (F.col("pos") <= head_length(c)))
    given = F.transform(heirs, lambda c: F.struct(c.alias("to"), F.lit(0).alias("part"), F.lit(True).alias("counts")))
    places = F.when((F.col("conv") % HEAD_GROUP == 0) & (F.col("pos") < HEAD_MODULUS), F.concat(F.array(own), given)).otherwise(F.array(own))
    return rows.select(F.explode(places).alias("p"), "pos", "turn_digest", "n_bytes").select(F.col("p.to").alias("conv"), "p.part", "pos", F.when(F.col("p.counts"), F.col("turn_digest")).alias("turn_digest"), "n_bytes")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix rows of sorted turns. A conversation without own rows has none; a head's few turns wait until that is known."""
    root = EMPTY.digest()
    conv, digest, depth, waiting, exists, out = None, root, 0, [], False, []

    def row(n_bytes: int, parent: bytes) -> None:
        out.append([conv, depth, digest, parent, n_bytes, False])

    def take(turn_digest: bytes, n_bytes: int) -> None:
        nonlocal digest, depth
        parent = digest
        digest, depth = hashlib.sha256(parent + turn_digest).digest(), depth + 1
        row(n_bytes, parent)

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 6
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], names=["conv", "depth", "digest", "parent", "n_bytes", "ends"])

    for batch in batches:
        for c, part, turn_digest, n_bytes in zip(*(batch.column(k).to_pylist() for k in ("conv", "part", "turn_digest", "n_bytes")), strict=True):
            if c != conv:
                if exists:
                    out[-1][5] = True
                if len(out) >= 10_000:
                    yield flush()
                conv, digest, depth, waiting, exists = c, root, 0, [], False
            if part == 0:
                waiting.append((turn_digest, n_bytes))
                continue
            if not exists:
                exists = True
                row(0, None)
                for head in waiting:
                    take(*head)
            if turn_digest is not None:
                if len(out) >= 10_000:  # the last row stays: it may be the conversation's end
                    last = out.pop()
                    yield flush()
                    out.append(last)
                take(turn_digest, n_bytes)
    if exists:
        out[-1][5] = True
    yield flush()


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, digest, parent, n_bytes, ends): every prefix of every conversation, the empty one included.

    ``rows`` has (conv, part, pos, turn_digest, n_bytes); turns follow each other by (part, pos). ``ends`` marks the whole conversation.
    """
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "part", "pos").select("conv", "part", "turn_digest", "n_bytes")
    return map_batches(dealt, _chain, "conv bigint, depth bigint, digest binary, parent binary, n_bytes bigint, ends boolean")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted (depth, digest, conv) rows, joined by commas into pieces of at most ``PIECE`` bytes."""
    key, first, ids, size, out = None, None, [], 0, []
    for batch in batches:
        for depth, digest, conv in zip(*(batch.column(k).to_pylist() for k in ("depth", "digest", "conv")), strict=True):
            if (depth, digest) != key or size >= PIECE:
                if ids:
                    out.append((*key, first, ",".join(ids)))
                key, first, ids, size = (depth, digest), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        yield _piece_batch(out)
    if ids:
        out.append((*key, first, ",".join(ids)))
    yield _piece_batch(out)


def _piece_batch(out: list) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[]] * 4
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.string()), strict=True)], names=["depth", "digest", "first", "piece"])


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's sorted pieces, joined by commas; one running hash is held."""
    key, running, out = None, None, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.string()), strict=True)], names=["depth", "digest", "ends_sha256"])

    for batch in batches:
        for depth, digest, piece in zip(*(batch.column(k).to_pylist() for k in ("depth", "digest", "piece")), strict=True):
            if (depth, digest) == key:
                running.update(b"," + piece.encode())
            else:
                if key:
                    out.append((*key, running.hexdigest()))
                key, running = (depth, digest), hashlib.sha256(piece.encode())
        yield flush()
    if key:
        out.append((*key, running.hexdigest()))
    yield flush()


def end_digests(rows: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256): SHA-256 of the ids of the conversations that end at a node, ascending, comma-joined.

    A node that a third of all conversations end at is cut by ranges of ids first; the last step hashes joined pieces in order.
    """
    ends = rows.where("ends").select("depth", "digest", "conv")
    ranged = ends.repartitionByRange("depth", "digest", "conv").sortWithinPartitions("depth", "digest", "conv")
    pieces = map_batches(ranged, _pieces, "depth bigint, digest binary, first bigint, piece string")
    ordered = pieces.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "first").select("depth", "digest", "piece")
    return map_batches(ordered, _hash_pieces, "depth bigint, digest binary, ends_sha256 string")


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row a node of the trie of ``prefixes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = materialise(rows, "prefixes")
    node = ["depth", "digest"]
    met = rows.groupBy(*node).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("n_bytes").alias("n_bytes"))
    met = materialise(met, "nodes")
    children = met.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    met = met.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    met = materialise(met, "nodes")
    # what a node has is carried to its ancestors, the prefix rows of its smallest conversation, added up from the last turn on
    gains = met.select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("gain"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"))
    both = rows.select("conv", *node, F.lit(0).cast("bigint").alias("gain"), F.lit(0).alias("leaf")).unionByName(gains, allowMissingColumns=True)
    towards_root = Window.partitionBy("conv").orderBy(F.col("depth").desc(), F.col("digest").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumns({"gain": F.sum("gain").over(towards_root), "leaf": F.sum("leaf").over(towards_root)}).where("digest is not null")
    sums = carried.groupBy(*node).agg(F.sum("leaf").alias("n_leaves"), F.sum("gain").alias("saved_tokens"))
    # only the top of a conversation's own nodes has a parent of another conversation
    above = met.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = met.join(sums, node).join(end_digests(rows), node, "left").join(above, ["depth", "parent"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY.hexdigest())).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, rebuilt with the heads that groups of five share."""
    rows = with_shared_heads(turns(table(spark, sf_dir, "conversations")))
    return trie_nodes(prefixes(rows))


#: CRC-32 (reflected, polynomial 0xEDB88320) bit by bit over the decimal digits; 8 steps a digit, the digit enters at the first.
_CRC32 = """xor(list_reduce(flatten(list_transform(string_split({c}::varchar, ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0])),
      lambda a, x: case when xor(a, x::bigint) & 1 = 1 then xor(xor(a, x::bigint) >> 1, 3988292384) else xor(a, x::bigint) >> 1 end, 4294967295), 4294967295)"""

OP13_SQL = f"""
with t as (
  select conv_id c, coalesce(role, '') r, coalesce(text, '') x,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) pos
  from conversations where conv_id is not null),
convs as (select c, {_CRC32.format(c="c")} % {HEAD_MODULUS} h from (select distinct c from t)),
rebuilt as (
  select convs.c, 0 part, pos, r, x from convs join t on t.c = convs.c - convs.c % {HEAD_GROUP} and pos <= h
  union all
  select convs.c, 1, pos, r, x from convs join t on t.c = convs.c and pos > h),
numbered as (select c, row_number() over (partition by c order by part, pos) d, r, x from rebuilt),
p as (
  select c, d, sha256(string_agg(length(r) || ':' || length(x) || ':' || r || x, '' order by d) over (partition by c order by d rows unbounded preceding)) k, strlen(x) b
  from numbered
  union all
  select c, 0, 'root', 0 from convs),
e as (select c, d, k, b, d = max(d) over (partition by c) e, lag(k) over (partition by c order by d) pk from p),
n as (
  select d, k, min(c) c, count(*) n, any_value(pk) pk, any_value(b) b, coalesce(string_agg(c::varchar, ',' order by c) filter (e), '') ends
  from e group by d, k),
kids as (select d - 1 d, pk k, count(*) kids from n where d > 0 group by 1, 2),
m as (select n.*, coalesce(kids, 0) kids from n left join kids using (d, k)),
sums as (
  select a.d, a.k, sum((m.n - 1) * m.b) saved, sum(case when m.kids = 0 then 1 else 0 end) leaves
  from m join e a on a.c = m.c and a.d <= m.d group by 1, 2)
select m.c::bigint conv_id, m.d::bigint depth, up.c::bigint parent_conv_id, m.n::bigint n_convs, m.kids::bigint n_children,
       leaves::bigint n_leaves, saved::bigint saved_tokens, sha256(m.ends) ends_sha256
from m join sums using (d, k) left join n up on up.d = m.d - 1 and up.k = m.pk
"""
