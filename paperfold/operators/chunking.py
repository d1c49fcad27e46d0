"""Cutting documents into size-bounded chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.plans.segments import carry, lead, prefix_sum, ranged, row_number, segmented, total
from paperfold.sources.shared import written

BLOCK = 4096  # pieces that are worked through together

# Route thresholds in characters and pages.
PAYLOAD_LIMIT, PAGE_LIMIT, CHUNKING_LIMIT = 40_000, 2, 100_000


def assign_chunks(pieces: DataFrame, doc: str, pos: str, size: str, limit: int,
                  overhead: str | None = None) -> DataFrame:
    """Greedy packing: append ``chunk_index`` (from 0) to each piece.

    A new chunk starts when the next piece would exceed ``limit`` and the chunk
    is not empty; an oversize piece stands alone.  ``overhead`` is what a chunk
    starting at a piece carries in front of it (not counted for the first).

    Where a chunk would start tells where the next one does: at the first piece
    whose running sum goes beyond.  Documents of up to BLOCK pieces follow these
    jumps inside one task; longer ones follow them by doubling, see ``_far_chunks``.
    """
    extra = F.col(overhead) if overhead else F.lit(0)
    src = written(pieces.select(doc, pos, F.col(size).cast("bigint").alias("__size"), extra.cast("bigint").alias("__extra")), "sized-pieces")
    long = written(src.groupBy(doc).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > BLOCK).select(doc), "long-documents")
    near = src.join(long, doc, "left_anti").repartition(doc).sortWithinPartitions(doc, pos)
    schema = f"`{doc}` {src.schema[doc].dataType.simpleString()}, `{pos}` {src.schema[pos].dataType.simpleString()}, chunk_index bigint"
    index = near.mapInArrow(_near_chunks(limit), schema)
    if not long.isEmpty():
        index = index.unionByName(_far_chunks(src.join(long, doc, "left_semi"), doc, pos, limit))
    return pieces.join(index, [doc, pos])


def _jumps(size: np.ndarray, extra: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """For pieces in a row, those of a document up to its ``ends``: where the chunk after one that starts here starts."""
    reach = np.cumsum(size)
    beyond = np.searchsorted(reach, reach - size - extra + limit, "right")
    return np.minimum(np.maximum(beyond, np.arange(len(size)) + 1), ends)


def _near_chunks(limit: int):
    """Chunk indexes of whole documents, for many of them at once; rows come sorted by document and position."""

    def numbered(t: pa.Table) -> pa.RecordBatch:
        size, extra = (t.column(c).to_numpy() for c in (2, 3))
        codes = t.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        counts = np.diff(np.append(heads, len(size)))
        after = np.append(heads[1:], len(size))
        extra = extra.copy()
        extra[heads] = 0
        jump = _jumps(size, extra, np.repeat(after, counts), limit)
        starts = np.zeros(len(size), bool)
        at = heads
        while len(at):
            starts[at] = True
            on = jump[at]
            stays = on < after
            at, after = on[stays], after[stays]
        index = np.cumsum(starts)
        index -= np.repeat(index[heads], counts)
        columns = [t.column(0).combine_chunks(), t.column(1).combine_chunks(), pa.array(index, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*t.column_names[:2], "chunk_index"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column(0)[batch.num_rows - 1]
            t = pa.Table.from_batches(held)
            # the last document may go on in the next batch
            same = pc.equal(t.column(0), last) if last.is_valid else pc.is_null(t.column(0))
            cut = t.num_rows - pc.sum(same).as_py()
            if cut:
                yield numbered(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield numbered(pa.Table.from_batches(held))

    return run


def _left_block(t: pa.Table) -> pa.Table:
    """For each piece of a block: where the jumps from it leave the block, and how many chunks start on the way."""
    order = np.argsort(t.column("rn").to_numpy())
    rn = t.column("rn").to_numpy()[order]
    to = t.column("next").fill_null(-1).to_numpy()[order]
    at = to - rn[0]
    inside = (at > 0) & (at < len(rn))
    hop, hops = np.where(inside, at, np.arange(len(rn))), inside.astype(np.int64)
    while (hop[hop] != hop).any():
        hops += hops[hop]
        hop = hop[hop]
    out = pa.array(to[hop], mask=to[hop] < 0)
    return pa.table({"doc": t.column("doc").take(pa.array(order)), "rn": rn, "out": out, "hops": hops + 1})


def _block_starts(t: pa.Table) -> pa.Table:
    """The pieces of a block at which chunks start, from the piece by which the jumps enter it."""
    order = np.argsort(t.column("rn").to_numpy())
    rn = t.column("rn").to_numpy()[order]
    to, n = (t.column(c).fill_null(-1).to_numpy()[order] for c in ("next", "n"))
    entries = np.flatnonzero(n >= 0)
    at, index, found = (int(entries[0]), int(n[entries[0]]), []) if len(entries) else (len(rn), 0, [])
    while 0 <= at < len(rn):
        found.append((at, index))
        at, index = int(to[at] - rn[0]) if to[at] >= 0 else -1, index + 1
    place = np.array([x[0] for x in found], np.int64)
    return pa.table({"doc": t.column("doc").take(pa.array(order[place])), "rn": rn[place], "chunk_index": np.array([x[1] for x in found], np.int64)})


def _far_chunks(src: DataFrame, doc: str, pos: str, limit: int) -> DataFrame:
    """(doc, pos, chunk_index) of long documents.

    An ordered search over running sums finds the jump of every piece.  Blocks of pieces resolve their own jumps; what
    leaves them is a graph with few pieces, on which the first piece's way is marked by doubling, so a document of n
    blocks takes log n equi joins.  No task holds a document.
    """
    kind = src.schema[doc].dataType.simpleString()
    rows = ranged(src, [doc], [pos], [row_number("rn"), prefix_sum(F.col("__size"), "__sum"), total("__n")])
    opens = F.col("__sum") - F.when(F.col("rn") == 1, 0).otherwise(F.col("__extra")) + limit
    rows = written(rows.select(F.col(doc).alias("doc"), pos, "rn", "__n", (F.col("__sum") + F.col("__size")).alias("reach"), opens.alias("opens")), "running-sums")
    # in falling order a start's threshold stands behind all pieces that go beyond it, the first of them last
    none = F.lit(None).cast("bigint")
    ends = rows.select("doc", "__n", (-F.col("reach")).alias("v"), F.lit(1).alias("k"), (-F.col("rn")).alias("o"), F.col("rn").alias("hit"))
    asks = rows.select("doc", "__n", (-F.col("opens")).alias("v"), F.lit(0).alias("k"), (-F.col("rn")).alias("o"), none.alias("hit"))
    found = ranged(ends.unionByName(asks), ["doc"], ["v", "k", "o"], [carry(F.col("hit"), "to")]).where("k = 0")
    to = F.greatest(F.col("to"), 1 - F.col("o"))
    jumps = found.select("doc", (-F.col("o")).alias("rn"), F.when(F.col("to").isNotNull() & (to <= F.col("__n")), to).alias("next"))
    jumps = written(jumps, "jumps")

    block = F.floor(F.col("rn") / BLOCK)
    left = written(jumps.groupBy("doc", block).applyInArrow(_left_block, f"doc {kind}, rn bigint, out bigint, hops bigint"), "left-blocks")
    first = F.col("rn") == 1
    used = left.where("out is not null").select("doc", F.col("out").alias("rn")).unionByName(left.where(first).select("doc", "rn")).distinct()
    ways = written(left.join(used, ["doc", "rn"], "left_semi"), "ways")
    marked = ways.where(first).select("doc", "rn", F.lit(0).cast("bigint").alias("n"))
    while not (on := ways.where("out is not null")).isEmpty():
        further = marked.join(on, ["doc", "rn"]).select("doc", F.col("out").alias("rn"), (F.col("n") + F.col("hops")).alias("n"))
        marked = written(marked.unionByName(further), "marked")
        then = ways.select(F.col("doc").alias("d"), F.col("rn").alias("r"), F.col("out").alias("out2"), F.col("hops").alias("hops2"))
        # ways that end here are not needed again: what they mark is marked
        ways = written(on.join(then, (F.col("doc") == F.col("d")) & (F.col("out") == F.col("r"))).select(
            "doc", "rn", F.col("out2").alias("out"), (F.col("hops") + F.col("hops2")).alias("hops")), "ways")
    entered = jumps.join(marked, ["doc", "rn"], "left")
    starts = entered.groupBy("doc", block).applyInArrow(_block_starts, f"doc {kind}, rn bigint, chunk_index bigint")
    out = rows.select("doc", pos, "rn").join(written(starts, "chunk-starts"), ["doc", "rn"], "left")
    out = ranged(out, ["doc"], ["rn"], [carry(F.col("chunk_index"), "__index")])
    return out.select(F.col("doc").alias(doc), pos, F.col("__index").alias("chunk_index"))


def chunk_table(assigned: DataFrame, doc: str, pos: str, size: str) -> DataFrame:
    """One row per chunk: first and last page, number of pages, size."""
    return assigned.groupBy(doc, "chunk_index").agg(
        F.min(pos).alias("page_from"), F.max(pos).alias("page_to"),
        F.count(F.lit(1)).alias("page_count"), F.sum(size).cast("bigint").alias("est_size"))


def regionless_to_all(chunks: DataFrame, pieces: DataFrame, doc: str) -> DataFrame:
    """Pieces without a page region belong to every chunk of their document: its range of chunks."""
    ends = chunks.groupBy(doc).agg(F.min("chunk_index").alias("first_chunk"), F.max("chunk_index").alias("last_chunk"))
    return pieces.join(ends, doc)


def table_headers(lines: DataFrame, doc: str = "doc_id", no: str = "line_no", text: str = "line") -> DataFrame:
    """Append the table header in force at each line: ``header`` and ``separator``, null outside tables.

    A header is a ``|`` line followed by a dashes line; any text line ends it,
    as do three blank lines in a row.
    """
    seg = [F.floor(F.col(no) / 256)]
    t, nxt = F.trim(F.col(text)), F.trim(F.coalesce("__next", F.lit("")))
    blank, piped = t == "", t.startswith("|")
    src = segmented(lines, [doc], [no], seg, [lead(F.col(text), "__next"), carry(F.when(~blank, F.col(no)), "__solid")])
    starts = piped & nxt.contains("-") & nxt.rlike(r"^\|[\s\-:|]+\|$")
    faded = blank & (F.col(no) - F.coalesce("__solid", F.lit(-1)) >= 3)
    ends = (~blank & ~piped) | faded
    pair = lambda h, s: F.struct(h.cast("string").alias("header"), s.cast("string").alias("separator"))
    event = F.when(starts, pair(F.col(text), F.col("__next"))).when(ends, pair(F.lit(None), F.lit(None)))
    src = written(src.select(*lines.columns, event.alias("__event")), "table-lines")
    src = segmented(src, [doc], [no], seg, [carry(F.col("__event"), "__state")])
    return src.select(*lines.columns, F.col("__state.header").alias("header"), F.col("__state.separator").alias("separator"))


def chunk_contents(assigned: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """Content of every chunk as a range of pieces; a chunk without any text takes the whole document's.

    Ranges instead of copies: blank chunks do not multiply the document.
    """
    own = assigned.groupBy(doc, "chunk_index").agg(
        F.min(pos).alias("__from"), F.max(pos).alias("__to"), F.bool_and(F.trim(text) == "").alias("fallback"))
    whole = assigned.groupBy(doc).agg(F.min(pos).alias("__first"), F.max(pos).alias("__last"))
    out = own.join(whole, doc)
    return out.select(doc, "chunk_index", F.when(F.col("fallback"), F.col("__first")).otherwise(F.col("__from")).alias("content_from"),
                      F.when(F.col("fallback"), F.col("__last")).otherwise(F.col("__to")).alias("content_to"), "fallback")


_CELL_TAG = r"\^C[0-9A-F]+"


def pack_lines(lines: DataFrame, limit: int, doc: str = "doc_id", no: str = "line_no", text: str = "line") -> DataFrame:
    """Lines with their chunk; inside a table a chunk opens with the header, without cell tags.

    ``prefix`` holds the repeated header on the line a chunk starts with.
    """
    src = table_headers(lines, doc, no, text)
    clean = F.regexp_replace("header", _CELL_TAG, "")
    prefix = F.when(F.col("header").isNotNull(), F.concat(clean, F.lit("\n"), F.col("separator"), F.lit("\n")))
    src = src.withColumn("prefix", prefix).withColumns({
        "__size": F.length(text) + 1, "__over": F.coalesce(F.length("prefix"), F.lit(0))})
    src = written(src, "sized-lines")
    out = written(assign_chunks(src, doc, no, "__size", limit, "__over"), "packed-lines")
    firsts = out.groupBy(doc, "chunk_index").agg(F.min(no).alias("__first"))
    out = out.join(firsts, [doc, "chunk_index"])
    opens = (F.col(no) == F.col("__first")) & (F.col("chunk_index") > 0)
    return out.select(*lines.columns, "chunk_index", F.when(opens, F.col("prefix")).alias("prefix"))


def sliding_windows(pages: DataFrame, doc: str, page: str, block: int = 256) -> DataFrame:
    """Windows of two pages, one shared; the single page left at the end is dropped unless it is all."""
    out = segmented(pages, [doc], [page], [F.floor(F.col(page) / block)], [lead(F.col(page), "next_page")])
    firsts = pages.groupBy(doc).agg(F.min(page).alias("__first"))
    out = out.join(firsts, doc)
    alone = (F.col(page) == F.col("__first")) & F.col("next_page").isNull()
    return out.where(F.col("next_page").isNotNull() | alone).select(doc, F.col(page).alias("page"), "next_page")


def split_ranges(segments: DataFrame, files: DataFrame, file: str) -> DataFrame:
    """Logical documents of a file: its native segments when there are several, else the whole file."""
    several = segments.groupBy(file).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select(file)
    native = segments.join(several, file, "left_semi").select(file, "doc_index", "start_page", "end_page")
    whole = files.join(several, file, "left_anti").select(
        file, F.lit(1).cast("bigint").alias("doc_index"), F.lit(1).cast("bigint").alias("start_page"), F.col("pages").alias("end_page"))
    both = native.unionByName(whole)
    return both.withColumn("page", F.explode(F.sequence("start_page", "end_page"))).select(file, "doc_index", "page")


def absolute_page(rel: Column, pages: Column) -> Column:
    """1-based position within the chunk's pages to the page itself; others unchanged."""
    return F.when((rel >= 1) & (rel <= F.size(pages)), F.try_element_at(pages, rel)).otherwise(rel)


def with_preamble(chunks: DataFrame, first_text: DataFrame, doc: str, keys: Sequence[str], chars: int,
                  labels: tuple[str, str]) -> DataFrame:
    """Context in front of every chunk but the first: the document's first ``chars`` characters and the expected keys.

    How much of the beginning is repeated is what the operator is for, so the caller says it; the chunks stay whole.
    """
    head = first_text.select(doc, F.rtrim(F.left("text", F.lit(chars))).alias("__head"))
    text = F.concat(F.lit(f"{labels[0]}\n"), F.col("__head"), F.lit(f"\n...\n\n{labels[1]} {', '.join(keys)}\n\n"))
    return chunks.join(head, doc).withColumn("preamble", F.when(F.col("chunk_index") > 0, text).otherwise("")).drop("__head")


def route_by_size(payload: Column, pages: Column) -> Column:
    return F.when((payload > PAYLOAD_LIMIT) | (pages > PAGE_LIMIT), "packed").otherwise("single")
