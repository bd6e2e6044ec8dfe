"""Minimax contiguous sharding (operator 11), DataFrame and SQL functions only.

Documents of equal text are one group, which no cut divides. Groups stand in the order of their
``place`` (60 bits of the text's MD5), and shards are runs of that order. The smallest shard
capacity is found by binary search: a capacity is feasible if shards that are filled greedily, as
far as the next group fits, hold everything. That filling gives each cut's last place, the same from the
other end its first; within both, and within the capacity, the groups are cut next to an equal share of
what is left (the greedy filling itself would leave the last shard half empty). Groups that no balance can help (not smaller than the mean of what is left for
the shards that are left) come first in the order, the largest first, one shard each; the search
goes over the rest.

The search never sees all groups at once. It begins with the sizes of ``1 << CELL_BITS`` cells of
places. The capacity that is feasible for whole cells, and the greedy filling with the least that any
capacity has, bound every cut; only cells between two such bounds are split, into ``1 << STEP_BITS``
each, until those are single groups. All other cells can hold no cut, so the result is that of the
search over all groups. A few thousand cells at each step, however many groups there are.

Slots: a shard's rows are dealt to blocks by a hash, blocks follow each other, and rows are numbered
within their block; so a shard that is one large group is numbered by many tasks.

Defined results: a null text is an empty one, of size 8; texts that share a place are one group;
null doc_ids are documents like any other, last in their block; equal rows are documents of their own
with a slot each; with fewer groups than shards the last shards are empty; an empty table
gives no rows; extra columns are ignored by ``shard`` and kept by ``write_shards``, which replaces a
column named ``shard``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHARDS = 24
PLACE_BITS, CELL_BITS, STEP_BITS = 60, 12, 4
#: Rows of a block of slots that are aimed at, and blocks of a shard at most.
BLOCK_ROWS, MOST_BLOCKS = 256, 4096
#: Equal rows that are numbered by one array.
_RUN = 65_536

PLACE = "cast(conv(substr(md5(cast(coalesce(text, '') as binary)), 1, 15), 16, 10) as bigint)"
DEAL = "cast(conv(substr(md5(cast(coalesce(cast(doc_id as string), '') as binary)), 1, 15), 16, 10) as bigint)"
SIZE = "cast(octet_length(coalesce(text, '')) as bigint) + 8"


@dataclass
class Cuts:
    """Places with a shard of their own, then the first places of the later shards; the largest shard's size."""

    alone: list[int]
    starts: list[int]
    capacity: int

    def shard(self, place: str) -> Column:
        longs = lambda xs: f"cast(array({', '.join(f'{x}L' for x in xs)}) as array<bigint>)"
        run = f"{len(self.alone)} + size(filter({longs(self.starts)}, c -> c <= {place}))"
        return F.expr(f"cast(coalesce(nullif(array_position({longs(self.alone)}, {place}), 0) - 1, {run}) as int)")


def _nearest(x: str, above: bool = False) -> str:
    """The largest of the rising ``ends`` that is not above ``x``, or the smallest that is not below it, by halving."""
    mid = "(b.l + b.h) div 2" if above else "(b.l + b.h + 1) div 2"
    low, high = f"named_struct('l', b.l, 'h', {mid})", f"named_struct('l', {mid} + 1, 'h', b.h)"
    if not above:
        low, high = f"named_struct('l', b.l, 'h', {mid} - 1)", f"named_struct('l', {mid}, 'h', b.h)"
    at = f"element_at(ends, cast({mid} as int))"
    step = f"if(b.l >= b.h, b, if({at} {'<' if above else '<='} {x}, {high}, {low}))"
    return f"element_at(ends, cast(aggregate(sequence(1, 40), named_struct('l', 1L, 'h', cast(size(ends) as bigint)), (b, i) -> {step}, b -> b.l) as int))"


def _filled(capacity: str, shards: int) -> str:
    """Where the greedy filling ends each shard."""
    return f"aggregate(sequence(1, {shards}), array(0L), (s, j) -> concat(s, array({_nearest(f'element_at(s, -1) + {capacity}')})))"


def _search(cells: DataFrame, shards: int, least: int) -> DataFrame:
    """One row: the least capacity for whole cells, cuts within it, and the filling with ``least``.

    cells: begin, end, of consecutive sizes. ``least``: what any capacity has at least.
    """
    row = cells.agg(F.sort_array(F.collect_list("end")).alias("rising"), F.max(F.col("end") - F.col("begin")).alias("widest"))
    row = row.selectExpr("concat(array(0L), rising) as ends", f"{least}L + widest as most")
    fits = f"aggregate(sequence(1, {shards}), 0L, (s, j) -> {_nearest('s + (c.l + c.h) div 2')}) = element_at(ends, -1)"
    halve = f"if(c.l >= c.h, c, if({fits}, named_struct('l', c.l, 'h', (c.l + c.h) div 2), named_struct('l', (c.l + c.h) div 2 + 1, 'h', c.h)))"
    row = row.selectExpr("ends", f"aggregate(sequence(1, 63), named_struct('l', {least}L, 'h', most), (c, i) -> {halve}, c -> c.l) as capacity")
    back = f"aggregate(sequence(1, {shards}), array(element_at(ends, -1)), (s, j) -> concat(array({_nearest('s[0] - capacity', above=True)}), s))"
    row = row.selectExpr("ends", "capacity", "element_at(ends, -1) as total", f"{back} as first", f"{_filled(f'{least}L', shards)} as low")
    # The boundary nearest to an equal share of what is left, as far as the capacity and the later shards let it.
    share = f"element_at(s, -1) + (total - element_at(s, -1)) div ({shards + 1} - j)"
    under, over = _nearest(share), _nearest(share, above=True)
    near = f"if(2 * ({share}) - {under} <= {over}, {under}, {over})"
    cut = f"greatest(first[j], least({near}, {_nearest('element_at(s, -1) + capacity')}))"
    return row.selectExpr("capacity", "total", "low", f"aggregate(sequence(1, {shards - 1}), array(0L), (s, j) -> concat(s, array({cut}))) as cuts"
                          if shards > 1 else "array(0L) as cuts")


def _cells(groups: DataFrame, bits: int) -> DataFrame:
    """cell (of 2**bits places), bits, size, n (groups)."""
    cell = F.shiftright("place", bits)
    return groups.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).withColumn("bits", F.lit(bits))


def minimax(groups: DataFrame, shards: int = SHARDS) -> Cuts:
    """Cuts for groups (place, size); a place stands once."""
    top = groups.orderBy(F.desc("size"), "place").limit(shards).agg(F.sort_array(F.collect_list(F.struct("size", "place")), asc=False).alias("top"))
    fits = f"s.on and s.n < {shards - 1} and x.size * ({shards} - s.n) >= s.rest"
    tried = top.crossJoin(groups.agg(F.sum("size").alias("total"))).selectExpr(
        "top", "total", "aggregate(top, named_struct('n', 0, 'rest', coalesce(total, 0L), 'on', true), (s, x) -> "
        f"if({fits}, named_struct('n', s.n + 1, 'rest', s.rest - x.size, 'on', true), named_struct('n', s.n, 'rest', s.rest, 'on', false))) as s")  # fmt: skip
    first = tried.selectExpr("s.n", "s.rest", "transform(slice(top, 1, s.n), x -> x.place) as alone",
                             "coalesce(get(top, 0).size, 0L) as largest", "coalesce(get(top, s.n).size, 0L) as next").first()
    if not first.rest:
        return Cuts(first.alone, [], first.largest)
    left, rest = shards - first.n, groups.filter(~F.col("place").isin(first.alone)) if first.alone else groups
    least = max(-(-first.rest // left), first.next)
    bits = PLACE_BITS - CELL_BITS
    cells = written(_cells(rest, bits), "cells")
    while True:
        # A bounded number of cells: they may be summed up in one task.
        ends = cells.selectExpr("*", "sum(size) over (order by shiftleft(cell, bits) rows unbounded preceding) as end").withColumn("begin", F.expr("end - size"))
        found = _search(ends, left, least).first()
        ranges = ((min(low, found.total - (left - j) * found.capacity), j * found.capacity) for j, low in enumerate(found.low) if 0 < j < left)
        bounds = ", ".join(f"named_struct('a', {a}L, 'b', {b}L)" for a, b in ranges)
        marked = ends.withColumn("open", F.expr(f"n > 1 and exists(array({bounds}), r -> end > r.a and begin < r.b)") if bounds else F.lit(False))
        split = marked.filter("open").select("cell")
        if bits == 0 or split.isEmpty():
            inner = [c for c in found.cuts[1:] if c < found.total]  # from the total on shards are empty, and begin beyond all places
            place = {r.begin: r.start for r in ends.filter(F.col("begin").isin(inner)).selectExpr("begin", "shiftleft(cell, bits) as start").collect()} if inner else {}
            return Cuts(first.alone, [place[c] for c in inner], max(found.capacity, first.largest if first.alone else 0))
        finer = max(0, bits - STEP_BITS)
        parts = _cells(rest.join(F.broadcast(split), F.shiftright("place", bits) == F.col("cell"), "left_semi"), finer)
        cells = written(marked.filter(f"not open or bits <> {bits}").select("cell", "size", "n", "bits").unionByName(parts.select("cell", "size", "n", "bits")), "cells")
        bits = finer


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, place, and how many rows are equal in these; a written table."""
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", f"{SIZE} as size", "crc32(cast(coalesce(text, '') as binary)) as text_crc32", f"{PLACE} as place")
    return written(rows.groupBy("doc_id", "size", "text_crc32", "place").agg(F.count("*").alias("copies")), "sized")


def _groups(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("place").agg(F.sum(F.col("size") * F.col("copies")).alias("size")), "groups")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    rows = sized(docs)
    cuts = minimax(_groups(rows), shards)
    blocks = max(1, min(MOST_BLOCKS, -(-rows.count() // BLOCK_ROWS)))
    dealt = rows.withColumn("shard", cuts.shard("place")).withColumn("block", F.expr(f"{DEAL} % {blocks}"))
    # At most shards * MOST_BLOCKS rows, about 40 bytes each.
    per = dealt.groupBy("shard", "block").agg(F.sum("copies").alias("n"))
    firsts = per.selectExpr("shard", "block", "sum(n) over (partition by shard order by block rows unbounded preceding) - n as first")
    placed = dealt.join(F.broadcast(firsts), ["shard", "block"]).withColumn("at", F.expr(
        "first + sum(copies) over (partition by shard, block order by doc_id nulls last, place rows unbounded preceding) - copies"))
    runs = placed.withColumn("run", F.explode(F.expr(f"sequence(0L, copies - 1, {_RUN}L)")))
    each = runs.withColumn("i", F.explode(F.expr(f"sequence(run, least(run + {_RUN - 1}L, copies - 1))")))
    return each.selectExpr("doc_id", "size", "text_crc32", "'bytes' as law", "shard", "at + i as slot", "cast(null as int) as grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 1) -> Cuts:
    """The documents, all their columns, as Parquet in a folder for each shard of at most ``files`` files."""
    rows = docs.selectExpr("doc_id", f"{SIZE} as size", f"{PLACE} as place", "1L as copies")
    cuts = minimax(_groups(rows), shards)
    out = docs.withColumn("shard", F.expr(PLACE)).withColumn("shard", cuts.shard("shard"))
    out = out.repartition(shards * files, "shard", F.pmod(F.xxhash64("doc_id"), F.lit(files)))
    out.write.partitionBy("shard").parquet(path)
    return cuts


def oracle(shards: int = SHARDS) -> str:
    """The same rows in DuckDB SQL, by prefix sums over all groups; CRC-32 byte by byte."""
    floor, ceil = "list_max(list_filter(ends, lambda e: e <= {}))", "list_min(list_filter(ends, lambda e: e >= {}))"
    share = "s[len(s)] + (total - s[len(s)]) // (k + 1 - j)"
    near = f"case when 2 * ({share}) - {floor.format(share)} <= {ceil.format(share)} then {floor.format(share)} else {ceil.format(share)} end"
    bits = "list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1])), 4294967295)"
    digits = "('0x' || substr(md5({}), 1, 15))::bigint"
    return f"""
with codes as materialized (select list(code order by n) as codes from (select n, {bits}::bigint as code from range(256) t(n))),
d as materialized (select doc_id, strlen(coalesce(text, '')) + 8 as size, {digits.format("coalesce(text, '')")} as place,
    {digits.format("coalesce(doc_id::varchar, '')")} as deal, (select codes from codes) as codes, coalesce(text, '') as text from documents),
g as (select place, sum(size)::bigint as size from d group by place),
top as (select list([size, place] order by size desc, place) as t, sum(size)::bigint as total from g),
lone as materialized (select list_reduce(list_prepend([0, total, 1], t[1:{shards}]), lambda s, x: case when s[3] = 1 and s[1] < {shards - 1} and x[1] * ({shards} - s[1]) >= s[2]
    then [s[1] + 1, s[2] - x[1], 1] else [s[1], s[2], 0] end) as s, t from top),
alone as (select unnest(list_transform(t[1:s[1]], lambda x: x[2])) as place, unnest(range(s[1])) as shard from lone),
rest as materialized (select place, size, sum(size) over (order by place)::bigint as e from g where place not in (select place from alone)),
p as materialized (select list_prepend(0, list(e order by e)) as ends, max(e) as total, max(size) as widest, {shards} - (select s[1] from lone) as k from rest),
c as materialized (select list_reduce(list_prepend([greatest((total + k - 1) // k, widest), (total + k - 1) // k + widest], list_transform(range(50), lambda i: [i, i])), lambda c, i:
    case when c[1] >= c[2] then c
    when list_reduce(list_prepend(0, range(1, k + 1)), lambda s, j: {floor.format('s + (c[1] + c[2]) // 2')}) >= total then [c[1], (c[1] + c[2]) // 2]
    else [(c[1] + c[2]) // 2 + 1, c[2]] end)[1] as cap, * from p),
f as materialized (select *, list_reduce(list_prepend([total], list_transform(range(k), lambda j: [j])), lambda s, j: list_prepend({ceil.format('s[1] - cap')}, s)) as first from c),
h as materialized (select list_reduce(list_prepend([0], list_transform(range(1, k), lambda j: [j])), lambda s, x: list_append(s, list_transform(x, lambda j:
    greatest(first[j + 1], least({near}, {floor.format('s[len(s)] + cap')})))[1])) as cuts from f),
b as (select least({MOST_BLOCKS}, greatest(1, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS})) as blocks from (select distinct doc_id, place from d)),
s as (select d.*, coalesce(a.shard, (select s[1] from lone) + (select len(list_filter(cuts[2:], lambda x: x < r.e)) from h))::int as shard
    from d left join alone a using (place) left join rest r using (place))
select doc_id, size::bigint as size, {crc}::bigint as text_crc32, 'bytes' as law, shard, null::int as grown_shard,
    row_number() over (partition by shard order by deal % (select blocks from b), doc_id nulls last, place) - 1 as slot from s
"""
