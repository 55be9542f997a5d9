"""Barcodes, primers, contamination, ranges: joins whose predicate isn't plain equality.

Small query sets (barcodes, primers) are compared with the few windows at a read's start within its row.
Larger ones and motifs that may lie anywhere are joined to the read's windows; such a set is broadcast only after
its size was checked, and all are met by pigeonhole seeds: of m + 1 pieces of a motif at least one is free of m errors, so pieces equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as sq

#: motifs up to which a set is looked for within each row, without a shuffle
IN_ROW = 500
#: rows up to which a query set is broadcast
BROADCAST_ROWS = 10_000
#: references up to which their k-mers are broadcast as arrays (some kilobytes each)
BROADCAST_REFS = 2_000


def _hits(reads: DataFrame, read_id: str, seq: Column, motifs: DataFrame, name: str, motif: str, errors: int, start: int, stop: int | None) -> DataFrame:
    """(read, name, offset, errors) for every motif within ``errors`` mismatches at an offset in [start, stop] (None: anywhere)."""
    small = motifs.select(F.col(name).alias("_name"), F.upper(motif).alias("_motif")).where(F.col(motif).isNotNull() & (F.length(motif) > 0))
    rows = reads.select(F.col(read_id).alias("_read"), F.upper(seq).alias("_seq"))
    pieces = errors + 1
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    seeds = small.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    width = F.floor(F.length("_motif") / pieces)
    seeds = seeds.withColumn("_at", (F.col("_piece") * width).cast("int")).withColumn("_len", F.when(F.col("_piece") == pieces - 1, F.length("_motif") - F.col("_at")).otherwise(width).cast("int"))
    seeds = seeds.withColumn("_seed", F.substring("_motif", F.col("_at") + 1, F.col("_len")))
    # a read is cut once per place and width of a piece; widths and the furthest piece are few values of the motif set
    shapes = seeds.groupBy("_len").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    cut = rows.where(F.col("_seq").isNotNull()).join(F.broadcast(shapes), F.length("_seq") >= F.col("_len"))
    last = F.length("_seq") - F.col("_len") if stop is None else F.least(F.length("_seq") - F.col("_len"), F.lit(stop) + F.col("_last"))
    cut = cut.where(last >= start + F.col("_first")).withColumn("_place", F.explode(F.sequence(F.lit(start) + F.col("_first"), last)))
    cut = cut.withColumn("_seed", F.substring("_seq", F.col("_place") + 1, F.col("_len")))
    met = cut.join(seeds, ["_len", "_seed"]).withColumn("_off", F.col("_place") - F.col("_at")).where((F.col("_off") >= start) & (F.length("_seq") >= F.col("_off") + F.length("_motif")))
    if stop is not None:
        met = met.where(F.col("_off") <= stop)
    met = met.withColumn("errors", sq.hamming(F.substring("_seq", F.col("_off") + 1, F.length("_motif")), F.col("_motif"))).where(F.col("errors") <= errors)
    return met.select("_read", "_name", F.col("_off").alias("offset"), "errors").distinct()


def _few(motifs: DataFrame, name: str, motif: str) -> list[tuple] | None:
    """The motif set as a list if it is small enough to be looked for within each row, else None."""
    named = motifs.select(F.col(name).alias("_name"), F.upper(motif).alias("_motif")).where(F.length("_motif") > 0)
    found = named.limit(IN_ROW + 1).collect()
    return None if len(found) > IN_ROW else sorted({(r["_name"], r["_motif"]) for r in found if r["_name"] is not None})


def _best_windows(motifs: list[tuple], errors: int, start: int, stop: int):
    """Rows (id, seq): for each the fewest errors, the offset and name of the first best motif, and how many names are as good.

    Every motif is compared with all windows of a batch at once, byte by byte.
    """
    deep = stop + max((len(m) for _, m in motifs), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            head = pc.fill_null(pc.utf8_upper(pc.utf8_slice_codeunits(batch.column(1), 0, deep)), "")
            size = np.asarray(pc.utf8_length(head)).astype(np.int64)
            flat = np.frombuffer("".join(head.to_pylist()).encode("ascii", "replace"), np.uint8)
            text = np.zeros((rows, max(deep, 1)), np.uint8)
            text[np.arange(text.shape[1]) < size[:, None]] = flat
            best, offset, which, ties = np.full(rows, errors + 1), np.zeros(rows, np.int64), np.full(rows, -1), np.zeros(rows, np.int64)
            for number, name in enumerate(sorted({n for n, _ in motifs})):
                own, at = np.full(rows, errors + 1), np.zeros(rows, np.int64)
                for _, motif in (x for x in motifs if x[0] == name):
                    letters = np.frombuffer(motif.encode("ascii", "replace"), np.uint8)
                    for o in range(start, stop + 1):
                        wrong = np.where(size >= o + letters.size, (text[:, o : o + letters.size] != letters).sum(1), errors + 1)
                        better = (wrong < own) | ((wrong == own) & (wrong <= errors) & (o < at))
                        own, at = np.where(better, wrong, own), np.where(better, o, at)
                ties = np.where(own < best, 1, ties + ((own == best) & (own <= errors)))
                first = (own < best) | ((own == best) & (own <= errors) & (at < offset))
                best, offset, which = np.where(first, own, best), np.where(first, at, offset), np.where(first, number, which)
            names = pa.array(sorted({n for n, _ in motifs}), pa.string())
            none = pa.array(which < 0)
            found = [names.take(pa.array(np.maximum(which, 0))) if len(names) else pa.nulls(rows, pa.string()), pa.array(best.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(ties.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pc.if_else(none, pa.nulls(rows, f.type), f) for f in found)], names=["_read", "_name", "errors", "offset", "_ties"])

    return run


def _all_windows(motifs: list[tuple], errors: int, most: int = 2_000_000):
    """Rows (id, seq): every place of every motif within ``errors`` mismatches. Texts of a batch are compared end to end, in slices of ``most`` letters."""
    coded = [(name, np.frombuffer(motif.encode("ascii", "replace"), np.uint8)) for name, motif in motifs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.asarray(pc.utf8_length(whole.column(1))).astype(np.int64)
            low = 0
            while low < whole.num_rows:
                high = max(low + 1, int(np.searchsorted(np.cumsum(sizes[low:]), most, "right")) + low)
                batch = whole.slice(low, high - low)
                low = high
                text = np.frombuffer("".join(pc.utf8_upper(batch.column(1)).to_pylist()).encode("ascii", "replace"), np.uint8)
                size = np.asarray(pc.utf8_length(pc.utf8_upper(batch.column(1)))).astype(np.int64)
                ends = np.cumsum(size)
                row_of = np.repeat(np.arange(size.size), size)
                rows, names, places, wrongs = [], [], [], []
                for name, motif in coded:
                    n = text.size - motif.size + 1
                    if n < 1:
                        continue
                    wrong = np.zeros(n, np.uint16)
                    for j, letter in enumerate(motif):
                        wrong += text[j : j + n] != letter
                    at = np.flatnonzero(wrong <= errors)
                    at = at[at + motif.size <= ends[row_of[at]]]
                    rows.append(row_of[at])
                    places.append(at - (ends - size)[row_of[at]])
                    wrongs.append(wrong[at])
                    names += [name] * at.size
                if rows:
                    where, offset, wrong = (np.concatenate(x) for x in (rows, places, wrongs))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), pa.array(names, pa.string()), pa.array(offset.astype(np.int32)), pa.array(wrong.astype(np.int32))], names=["_read", "_name", "offset", "errors"])

    return run


def _in_row(reads: DataFrame, read_id: str, seq: Column, motifs: list[tuple], errors: int, start: int, stop: int) -> DataFrame:
    """(read, _name, errors, offset, _ties), one row per row of ``reads``, nulls without a hit: no shuffle."""
    kind = dict(reads.dtypes)[read_id]
    rows = reads.select(F.col(read_id).alias("_read"), seq.cast("string").alias("_seq"))
    return rows.mapInArrow(_best_windows(motifs, errors, start, stop), f"_read {kind}, _name string, errors int, offset int, _ties int").withColumnRenamed("_read", read_id)


def demultiplex(reads: DataFrame, read_id: str, seq: str, barcodes: DataFrame, mid: str, barcode: str, *, errors: int = 1, start: int = 0, stop: int = 2) -> DataFrame:
    """(read_id, mid, outcome, errors, offset): the barcode with fewest errors at the read's start.

    Outcome MATCH for exactly one best barcode, AMBIGUOUS for several with equally few errors, NO_MATCHING
    for none (mid, errors and offset are null). Among offsets of one barcode the smallest counts. Reads
    with a null sequence get NO_MATCHING; null or empty barcodes match nothing. Up to IN_ROW barcodes are looked for within
    each row; more are joined, where rows of one id share their best hit.
    """
    few = _few(barcodes, mid, barcode)
    if few is not None:
        tied = F.col("_ties") == 1
        outcome = F.when(F.col("_ties").isNull(), "NO_MATCHING").when(tied, "MATCH").otherwise("AMBIGUOUS")
        found = _in_row(reads, read_id, F.col(seq), few, errors, start, stop)
        return found.select(read_id, F.when(tied, F.col("_name")).alias("mid"), outcome.alias("outcome"), "errors", F.when(tied, F.col("offset")).alias("offset"))
    hits = _hits(reads, read_id, F.col(seq), barcodes, mid, barcode, errors, start, stop)
    per = hits.groupBy("_read", "_name").agg(F.min(F.struct("errors", "offset")).alias("h"))
    best = per.groupBy("_read").agg(F.min("h.errors").alias("errors"), F.min(F.struct("h.errors", "h.offset", "_name")).alias("w"), F.collect_list("h.errors").alias("_all"))
    tied = F.size(F.filter("_all", lambda e: e == F.col("errors")))
    found = best.select(
        F.col("_read").alias(read_id), F.when(tied == 1, F.col("w._name")).alias("mid"), F.when(tied == 1, "MATCH").otherwise("AMBIGUOUS").alias("outcome"), "errors", F.when(tied == 1, F.col("w.offset")).alias("offset")
    )
    return reads.select(read_id).join(found, read_id, "left").withColumn("outcome", F.coalesce("outcome", F.lit("NO_MATCHING")))


def match_primers(reads: DataFrame, read_id: str, seq: str, targets: DataFrame, target: str, primer: str, *, errors: int = 3, within: int = 10, reverse: bool = False) -> DataFrame:
    """(read_id, matched, errors, offset): the target whose primer fits best near the start (``reverse``: of the reverse complement).

    Fewest errors first, then the earliest place, then the smaller target name; ``matched`` is 'unrecognized' without any.
    Up to IN_ROW primers are looked for within each row; more are joined.
    """
    oriented = sq.revcomp(F.col(seq)) if reverse else F.col(seq)
    few = _few(targets, target, primer)
    if few is not None:
        found = _in_row(reads, read_id, oriented, few, errors, 0, within)
        return found.select(read_id, F.coalesce("_name", F.lit("unrecognized")).alias("matched"), "errors", "offset")
    hits = _hits(reads, read_id, oriented, targets, target, primer, errors, 0, within)
    best = hits.groupBy("_read").agg(F.min(F.struct("errors", "offset", F.col("_name").alias("name"))).alias("h"))
    found = best.select(F.col("_read").alias(read_id), F.col("h.name").alias("matched"), F.col("h.errors").alias("errors"), F.col("h.offset").alias("offset"))
    return reads.select(read_id).join(found, read_id, "left").withColumn("matched", F.coalesce("matched", F.lit("unrecognized")))


def match_oriented(reads: DataFrame, read_id: str, seq: str, targets: DataFrame, target: str, primer: str, *, errors: int = 3, within: int = 10, suffix: str = "_Comp") -> DataFrame:
    """``match_primers``, tried on the reverse complement where the read itself matches nothing.

    Columns read_id, matched, errors, offset, complement and label: the name of the target, with ``suffix`` if the complement
    matched. Rows whose id comes again must have the same sequence; a null sequence is unrecognized.
    """
    back = sq.revcomp(F.col(seq))
    few = _few(targets, target, primer)
    if few is None:
        rows = reads.select(read_id, seq).dropDuplicates([read_id])
        one, two = (match_primers(rows, read_id, seq, targets, target, primer, errors=errors, within=within, reverse=r) for r in (False, True))
        both = one.join(two.select(read_id, F.struct("matched", "errors", "offset").alias("_c")), read_id)
        ahead = F.struct("matched", "errors", "offset")
    else:
        kind = dict(reads.dtypes)[read_id]
        strands = reads.select(F.col(read_id).alias("_id"), back.cast("string").alias("_back"), F.col(seq).cast("string").alias("_seq"))
        both = strands.mapInArrow(_two_strands(few, few, errors, within), f"`{read_id}` {kind}, a_name string, a_errors int, a_offset int, c_name string, c_errors int, c_offset int")
        unknown = F.lit("unrecognized")
        ahead = F.struct(F.coalesce("a_name", unknown).alias("matched"), F.col("a_errors").alias("errors"), F.col("a_offset").alias("offset"))
        both = both.withColumn("_c", F.struct(F.coalesce("c_name", unknown).alias("matched"), F.col("c_errors").alias("errors"), F.col("c_offset").alias("offset")))
    turned = (ahead["matched"] == "unrecognized") & (F.col("_c.matched") != "unrecognized")
    chosen = both.select(read_id, F.when(turned, F.col("_c")).otherwise(ahead).alias("_h"), turned.alias("complement"))
    return chosen.select(read_id, "_h.matched", "_h.errors", "_h.offset", "complement", F.when(F.col("complement"), F.concat("_h.matched", F.lit(suffix))).otherwise(F.col("_h.matched")).alias("label"))


def _two_strands(motifs: list[tuple], back_motifs: list[tuple], errors: int, within: int):
    kernels = [_best_windows(m, errors, 0, within) for m in (motifs, back_motifs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, back, seq = (batch.column(c) for c in range(3))
            one, two = (next(kernel(iter([pa.RecordBatch.from_arrays([ids, s], names=["id", "seq"])]))) for kernel, s in zip(kernels, (seq, back), strict=True))
            hits = [x.column(c) for x in (one, two) for c in ("_name", "errors", "offset")]
            yield pa.RecordBatch.from_arrays([ids, *hits], names=["_id", "a_name", "a_errors", "a_offset", "c_name", "c_errors", "c_offset"])

    return run


def orientation_counts(oriented: DataFrame, *, least: int = 250, share: float = 0.2) -> DataFrame:
    """Per target of ``match_oriented``: reads forward, complement and in all, the complement's share, the target's share of all matched."""
    hits = oriented.where("matched != 'unrecognized'")
    per = hits.groupBy(F.col("matched").alias("target")).agg(F.count_if(~F.col("complement")).alias("forward"), F.count_if(F.col("complement")).alias("complement"), F.count("*").alias("total"))
    full = per.crossJoin(F.broadcast(per.agg(F.sum("total").alias("_all"))))
    many = (F.col("total") >= least) & (F.col("complement") >= share * F.col("total"))
    return full.select("target", "forward", "complement", "total", F.round(F.col("complement") / F.col("total"), 6).alias("complement_share"), F.round(F.col("total") / F.col("_all"), 6).alias("fraction"), many.alias("check_complement"))


def dual_barcodes(forward: DataFrame, reverse: DataFrame, read_id: str) -> DataFrame:
    """(read_id, mid, outcome) of two ``demultiplex`` results: both must name the same barcode pair.

    MATCH if both match the same mid, MISMATCHED if they match different ones, AMBIGUOUS if either is, else NO_MATCHING
    (also where only one of them matched). Ids must be unique.
    """
    both = forward.select(read_id, F.col("mid").alias("_f"), F.col("outcome").alias("_fo")).join(reverse.select(read_id, F.col("mid").alias("_r"), F.col("outcome").alias("_ro")), read_id)
    matched = (F.col("_fo") == "MATCH") & (F.col("_ro") == "MATCH")
    outcome = F.when(matched & (F.col("_f") == F.col("_r")), "MATCH").when(matched, "MISMATCHED").when(F.array_contains(F.array("_fo", "_ro"), "AMBIGUOUS"), "AMBIGUOUS").otherwise("NO_MATCHING")
    return both.select(read_id, F.when(outcome == "MATCH", F.col("_f")).alias("mid"), outcome.alias("outcome"))


def match_primer_pairs(reads: DataFrame, read_id: str, seq: str, targets: DataFrame, target: str, fwd: str, rev: str, *, errors: int = 3, within: int = 10) -> DataFrame:
    """``primer_pairs`` of a read's forward and reverse primer: both strands in one pass over the rows if the sets are small.

    The reverse primer stands at the end of the read as it is written, so its complement starts the reverse complement.
    """
    back = targets.select(target, sq.revcomp(F.upper(rev)).alias("_p"))
    few, few_back = _few(targets, target, fwd), _few(back, target, "_p")
    if few is None or few_back is None:
        one = match_primers(reads, read_id, seq, targets, target, fwd, errors=errors, within=within)
        return primer_pairs(one, match_primers(reads, read_id, seq, back, target, "_p", errors=errors, within=within, reverse=True), read_id)
    kind = dict(reads.dtypes)[read_id]
    strands = reads.select(F.col(read_id).alias("_id"), sq.revcomp(F.col(seq)).cast("string").alias("_back"), F.col(seq).cast("string").alias("_seq"))
    both = strands.mapInArrow(_two_strands(few, few_back, errors, within), f"`{read_id}` {kind}, fwd string, a_errors int, a_offset int, rev string, c_errors int, c_offset int")
    named = both.select(read_id, F.coalesce("fwd", F.lit("unrecognized")).alias("fwd"), F.coalesce("rev", F.lit("unrecognized")).alias("rev"))
    return named.withColumn("pair", _pair_outcome())


def _pair_outcome() -> Column:
    unknown = (F.col("fwd") == "unrecognized") | (F.col("rev") == "unrecognized")
    return F.when(unknown, "unrecognized").when(F.col("fwd") == F.col("rev"), "matched").otherwise("mismatched")


def primer_pairs(forward: DataFrame, reverse: DataFrame, read_id: str) -> DataFrame:
    """(read_id, fwd, rev, pair): matched, mismatched or unrecognized."""
    both = forward.select(read_id, F.col("matched").alias("fwd")).join(reverse.select(read_id, F.col("matched").alias("rev")), read_id)
    return both.withColumn("pair", _pair_outcome())


def zero_filled_counts(keys: DataFrame, key: str, rows: DataFrame, row_key: str) -> DataFrame:
    """Every key of ``keys`` with its number of rows (0 included) and its share of all counted rows."""
    counts = rows.groupBy(F.col(row_key).alias(key)).agg(F.count("*").alias("n"))
    full = keys.select(key).distinct().join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.crossJoin(F.broadcast(full.agg(F.sum("n").alias("total")))).withColumn("fraction", F.when(F.col("total") > 0, F.round(F.col("n") / F.col("total"), 6)).otherwise(0.0))


def kmer_screen(reads: DataFrame, read_id: str, seq: str, refs: DataFrame, ref_seq: str, by: list[str], *, k: int = 5, halves: int = 1) -> DataFrame:
    """(read_id, best): the largest number of distinct k-mers shared with one reference of the same key, for reads that pass.

    A read passes where ``2 * shared >= halves * own`` for some reference. A reference set of checked size is
    broadcast, its k-mers as one array per reference, and a read never leaves its row; a larger one meets the reads
    in an equi-join on (key, k-mer). ``by`` may be empty (all references). A read without any k-mer never passes.
    """
    own = F.array_distinct(sq.kmers(F.upper(seq), k))
    left = reads.select(F.col(read_id).alias("_read"), *by, own.alias("_k"))
    right = refs.where(F.col(ref_seq).isNotNull()).select(*by, F.upper(ref_seq).alias("_r"), F.array_distinct(sq.kmers(F.upper(ref_seq), k)).alias("_rk"))
    if refs.limit(BROADCAST_REFS + 1).count() <= BROADCAST_REFS:
        met = left.join(F.broadcast(right), by) if by else left.crossJoin(F.broadcast(right))
        counted = met.select("_read", F.size("_k").alias("_own"), F.size(F.array_intersect("_k", "_rk")).cast("long").alias("_n"))
    else:
        # a reference or a read row that comes again must not count its k-mers again; an id may come with several texts and keys
        exploded = right.dropDuplicates([*by, "_r"]).select(*by, F.md5("_r").alias("_ref"), F.explode("_rk").alias("_kmer"))
        rows = left.withColumn("_k", F.array_sort("_k")).distinct().withColumn("_row", F.md5(F.array_join("_k", ",")))
        long = rows.select("_read", "_row", *by, F.size("_k").alias("_own"), F.explode("_k").alias("_kmer"))
        counted = long.join(exploded, [*by, "_kmer"]).groupBy("_read", "_row", *by, "_own", "_ref").agg(F.count("*").alias("_n"))
    passed = counted.where((F.col("_n") > 0) & (F.col("_n") * 2 >= F.col("_own") * halves))
    return passed.groupBy(F.col("_read").alias(read_id)).agg(F.max("_n").alias("best"))


def motif_hits(seqs: DataFrame, seq_id: str, seq: str, motifs: DataFrame, name: str, motif: str, errors: int) -> DataFrame:
    """(seq_id, name, strand, start, end, errors): all places of motifs within ``errors`` mismatches, both strands, half-open from 0.

    A set of up to IN_ROW motifs (of both strands) is compared with all places of a row at once; a larger one is
    found by pigeonhole seeds (an equi-join), verified by mismatches. Degenerate motifs are to be expanded first
    (``expand_motif``). Null sequences and motifs are nowhere.
    """
    both = motifs.select(F.col(name).alias("_n"), F.upper(motif).alias("_m")).where(F.col(motif).isNotNull())
    strands = both.select(F.concat(F.lit("+"), "_n").alias("_n"), "_m").unionByName(both.select(F.concat(F.lit("-"), "_n").alias("_n"), sq.revcomp(F.col("_m")).alias("_m")))
    few = _few(strands, "_n", "_m")
    if few is not None:
        kind = dict(seqs.dtypes)[seq_id]
        rows = seqs.select(F.col(seq_id).alias("_read"), F.col(seq).cast("string").alias("_seq")).where("length(_seq) > 0")
        hits = rows.mapInArrow(_all_windows(few, errors), f"_read {kind}, _name string, offset int, errors int").distinct()
    else:
        hits = _hits(seqs, seq_id, F.col(seq), strands, "_n", "_m", errors, 0, None)
    sized = hits.join(strands.select(F.col("_n").alias("_name"), F.length("_m").alias("_w")), "_name")
    return sized.select(
        F.col("_read").alias(seq_id), F.substring("_name", 2, 1000).alias(name), F.substring("_name", 1, 1).alias("strand"), F.col("offset").alias("start"), (F.col("offset") + F.col("_w")).alias("end"), "errors"
    )


def best_hits(hits: DataFrame, seq_id: str) -> DataFrame:
    """Of several hits over one place only the one with fewest errors (ties: the smaller motif)."""
    w = Window.partitionBy(seq_id, "strand", "start", "end").orderBy("errors", "motif")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def amplicons(forward: DataFrame, reverse: DataFrame, seq_id: str, limit: int = 1000) -> DataFrame:
    """Forward and reverse hits of one target that can amplify: opposite strands, forward first, apart, insert up to ``limit``."""
    f = forward.select(seq_id, "target", F.col("strand").alias("f_strand"), F.col("start").alias("f_start"), F.col("end").alias("f_end"), F.col("errors").alias("f_err"))
    r = reverse.select(seq_id, "target", F.col("strand").alias("r_strand"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("errors").alias("r_err"))
    plus = (F.col("f_strand") == "+") & (F.col("r_strand") == "-") & (F.col("r_start") > F.col("f_end")) & (F.col("r_start") - F.col("f_end") <= limit)
    minus = (F.col("f_strand") == "-") & (F.col("r_strand") == "+") & (F.col("f_start") > F.col("r_end")) & (F.col("f_start") - F.col("r_end") <= limit)
    met = f.join(r, [seq_id, "target"]).where(plus | minus)
    return met.withColumn("ins_start", F.least("f_end", "r_end")).withColumn("ins_end", F.greatest("f_start", "r_start"))


def interval_overlaps(left: DataFrame, right: DataFrame, key: str, lstart: str, lend: str, rstart: str, rend: str, width: int) -> DataFrame:
    """Pairs of half-open intervals of one key that overlap. Both sides are spread over bins of ``width``, so the join is an
    equi-join on (key, bin); a pair is reported only from the bin where its overlap begins, so none comes twice.
    Column names of the two sides must differ, but for the key. Null or empty intervals overlap nothing."""

    def spread(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))

    met = spread(left, lstart, lend).join(spread(right, rstart, rend), [key, "_bin"])
    met = met.where((F.col(lstart) < F.col(rend)) & (F.col(rstart) < F.col(lend)))
    return met.where(F.floor(F.greatest(lstart, rstart) / width) == F.col("_bin")).drop("_bin")


def pcr_counts(seqs: DataFrame, seq_id: str, targets: DataFrame, target: str, forward: DataFrame, reverse: DataFrame, found: DataFrame) -> DataFrame:
    """(seq_id, target, forward, reverse, amplicons): hits and extractions of every sequence and target that occur, zeros included.

    ``forward`` and ``reverse`` are hits, ``found`` their amplicons, all with a column ``target``. The keys are all sequences with
    any hit times all targets: a table of the size of the report.
    """
    count = lambda df, n: df.groupBy(seq_id, "target").agg(F.count("*").alias(n))
    hit = forward.select(seq_id).unionByName(reverse.select(seq_id)).distinct()
    keys = seqs.select(seq_id).distinct().join(hit, seq_id, "left_semi").crossJoin(targets.select(F.col(target).alias("target")).distinct())
    out = keys
    for df, n in ((forward, "forward"), (reverse, "reverse"), (found, "amplicons")):
        out = out.join(count(df, n), [seq_id, "target"], "left")
    return out.fillna(0, ["forward", "reverse", "amplicons"])


def paired_screen(reads: DataFrame, read_id: str, first: str, second: str, refs: DataFrame, ref_seq: str, by: list[str], *, k: int = 5, halves: int = 1) -> DataFrame:
    """(read_id): pairs of which the first mate and the complement of the second both pass ``kmer_screen``'s test with one and the same reference.

    Ids must be unique. Up to BROADCAST_REFS references (checked) are broadcast; more are met reference by reference through the shared
    k-mers of the first mate. A pair with a null or too short mate doesn't pass.
    """
    distinct = lambda c: F.array_distinct(sq.kmers(c, k))
    left = reads.select(read_id, *by, distinct(F.upper(first)).alias("_a"), distinct(sq.revcomp(F.upper(second))).alias("_b")).where("size(_a) > 0 and size(_b) > 0")
    right = refs.where(F.col(ref_seq).isNotNull()).select(*by, distinct(F.upper(ref_seq)).alias("_rk"))
    if refs.limit(BROADCAST_REFS + 1).count() <= BROADCAST_REFS:
        met = left.join(F.broadcast(right), by) if by else left.crossJoin(F.broadcast(right))
    else:
        numbered = right.withColumn("_ref", F.md5(F.array_join(F.array_sort("_rk"), ","))).dropDuplicates([*by, "_ref"])
        shared = left.select(read_id, *by, F.explode("_a").alias("_kmer")).join(numbered.select(*by, "_ref", F.explode("_rk").alias("_kmer")), [*by, "_kmer"])
        enough = shared.groupBy(read_id, *by, "_ref").agg(F.count("*").alias("_n")).drop("_n")
        met = enough.join(left, [read_id, *by]).join(numbered, [*by, "_ref"])
    passes = lambda own: F.size(F.array_intersect(own, "_rk")) * 2 >= F.size(own) * halves
    some = (F.size(F.array_intersect("_a", "_rk")) > 0) & (F.size(F.array_intersect("_b", "_rk")) > 0)
    return met.where(some & passes("_a") & passes("_b")).select(read_id).distinct()
