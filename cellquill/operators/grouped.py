"""Algorithms that follow an order within a group and so run in Python: UMI correction, collisions, EM, prediction.

UMI correction sees one barcode at a time: at most 4 ** umilen UMIs. The others get pre-aggregated rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.hints import dictionary
from .count import MOLECULE, classes, molecules


def gene_sets(ec_gene: DataFrame) -> DataFrame:
    return ec_gene.groupBy("ec").agg(F.array_sort(F.collect_set("gene")).alias("genes"))


def merge_umis(umis: np.ndarray, counts: np.ndarray, genes: list[int], umilen: int) -> np.ndarray:
    """For each distinct UMI of a barcode the UMI it becomes; ``genes`` are sets as bits.

    An edge leads from a molecule to one that differs in a base, shares a gene, and has at most half its count (rounded up).
    In a component, molecules without an edge into them (else the first) take over what they reach, as long as the
    shared genes last; this repeats while more than one is left.
    """
    at = {u: i for i, u in enumerate(umis.tolist())}
    flips = [x << (2 * k) for k in range(umilen) for x in (1, 2, 3)]
    near = [sorted(j for f in flips if (j := at.get(u ^ f)) is not None and genes[i] & genes[j]) for i, u in enumerate(umis.tolist())]
    counts = counts.tolist()
    after = [[j for j in js if counts[i] >= 2 * counts[j] - 1] for i, js in enumerate(near)]
    before = [[i for i in js if counts[i] >= 2 * counts[j] - 1] for j, js in enumerate(near)]
    target, done = np.arange(len(umis)), np.zeros(len(umis), bool)
    for first in range(len(umis)):
        if done[first]:
            continue
        pool, todo = {first}, [first]
        while todo:
            i = todo.pop()
            for j in (*after[i], *before[i]):
                if j not in pool:
                    pool.add(j)
                    todo.append(j)
        done[list(pool)] = True
        while len(pool) > 1:
            originals = sorted(i for i in pool if not any(j in pool for j in before[i])) or [min(pool)]
            for original in originals:
                if original not in pool:
                    continue
                pool.discard(original)
                shared, stack = genes[original], [iter(after[original])]
                while stack:
                    j = next(stack[-1], None)
                    if j is None:
                        stack.pop()
                    elif j in pool and shared & genes[j]:
                        shared = shared & genes[j]
                        pool.discard(j)
                        target[j] = original
                        stack.append(iter(after[j]))
    return umis[target]


def correct_umis(bus: DataFrame, ec_gene: DataFrame, umilen: int) -> DataFrame:
    """Records with corrected UMIs; those of one molecule and class are summed.

    Molecules are taken in order of their first record (``_rid``, where there is one), then of their UMI. Records without a
    class are left out.
    """
    first = F.min("_rid") if "_rid" in bus.columns else F.lit(0).cast("long")
    rows = bus.where("ec IS NOT NULL").groupBy("barcode", "umi", "ec").agg(F.sum("count").alias("count"), F.min("flags").alias("flags"), F.min("pad").alias("pad"), first.alias("first"))
    # a set travels as one string, which becomes a bit for each of the cell's genes
    rows = rows.join(dictionary(gene_sets(ec_gene).select("ec", F.array_join("genes", "\n").alias("genes"))), "ec", "left")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        umi, ec, first = (pdf[c].to_numpy() for c in ("umi", "ec", "first"))
        codes, names = pd.factorize(pdf["genes"])
        bit: dict[str, int] = {}
        masks = [sum(1 << bit.setdefault(g, len(bit)) for g in s.split("\n")) if s else 0 for s in names]
        held = np.array([*masks, 0], object)[codes]  # the last is that of no set, -1
        _, molecule = np.unique(umi, return_inverse=True)
        least = np.full(molecule.max() + 1, first.max())
        np.minimum.at(least, molecule, first)
        order = np.lexsort((ec, umi, least[molecule]))
        umi, ec, count, flags, pad = (pdf[c].to_numpy()[order] for c in ("umi", "ec", "count", "flags", "pad"))
        starts = np.flatnonzero(np.r_[True, umi[1:] != umi[:-1]])
        genes = np.bitwise_and.reduceat(held[order], starts).tolist()
        merged = merge_umis(umi[starts], np.add.reduceat(count, starts), genes, umilen)
        umi = np.repeat(merged, np.diff(np.r_[starts, len(umi)]))
        # sums by molecule and class; flags and pad are those of the first record
        order = np.lexsort((ec, umi))
        umi, ec, count, flags, pad = (x[order] for x in (umi, ec, count, flags, pad))
        heads = np.flatnonzero(np.r_[True, (umi[1:] != umi[:-1]) | (ec[1:] != ec[:-1])])
        return pd.DataFrame({"barcode": pdf["barcode"].iloc[0], "umi": umi[heads], "ec": ec[heads], "count": np.add.reduceat(count, heads), "flags": flags[heads], "pad": pad[heads]})

    return rows.groupBy("barcode").applyInPandas(one, "barcode long, umi long, ec int, count long, flags long, pad long")


def collided(sets: list[frozenset]) -> list[frozenset]:
    """Gene sets of the molecules that share a UMI: each sweep takes every class that keeps the genes in common."""
    left, out = [s for s in sets if s], []
    while left:
        shared, rest = left[0], []
        for s in left[1:]:
            if shared & s:
                shared = shared & s
            else:
                rest.append(s)
        out.append(shared)
        left = rest
    return out


def gene_counts_with_collisions(bus: DataFrame, ec_gene: DataFrame) -> DataFrame:
    """Gene counts where a UMI without a common gene counts as several molecules."""
    # each molecule's known classes with their genes, and the genes that all its classes share; one dealing out serves both branches
    sets = classes(bus).join(dictionary(gene_sets(ec_gene)), "ec").groupBy(*MOLECULE).agg(F.array_sort(F.collect_list(F.struct("ec", "genes"))).alias("sets"), F.first("n_ec").alias("n_ec"))
    sets = sets.select("barcode", F.transform("sets", lambda x: x["genes"]).alias("sets"), "n_ec")
    shared = F.when(F.size("sets") == F.col("n_ec"), F.aggregate("sets", F.get("sets", F.lit(0)), F.array_intersect)).otherwise(F.array().cast("array<string>"))
    sets = sets.select("barcode", "sets", shared.alias("shared"))
    clash = sets.where("size(shared) = 0").select("barcode", "sets")

    def sweep(batches):
        for b in batches:
            found = [(c, next(iter(s))) for c, sets in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in collided([frozenset(x) for x in sets]) if len(s) == 1]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["barcode", "gene"])

    every = sets.where("size(shared) = 1").select("barcode", F.get("shared", F.lit(0)).alias("gene")).unionByName(clash.mapInArrow(sweep, "barcode long, gene string"))
    return every.groupBy("barcode", "gene").agg(F.count(F.lit(1)).cast("double").alias("value"))


def expectation_maximisation(unique: dict[str, float], shared: list[tuple[tuple[str, ...], float]], rounds: int = 100, tolerance: float = 1e-3) -> dict[str, float]:
    """Shared molecules dealt out among the genes that have unique ones."""
    now = dict(unique)
    for _ in range(rounds):
        new = dict(unique)
        for genes, n in shared:
            total = sum(now.get(g, 0.0) for g in genes)
            for g in genes:
                if total > 0 and g in now:
                    new[g] += n * now[g] / total
        change = sum(abs(new[g] - now[g]) / (new[g] + now[g]) for g in new)
        now = new
        if change < tolerance:
            break
    return now


def gene_counts_em(bus: DataFrame, ec_gene: DataFrame) -> DataFrame:
    """Gene counts with ambiguous molecules dealt out by EM in each cell."""
    sets = molecules(bus, ec_gene).groupBy(*MOLECULE).agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    sets = sets.groupBy("barcode", "genes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = sets.groupBy("barcode").agg(F.array_sort(F.collect_list(F.struct("genes", "n"))).alias("sets"))

    def deal(batches):
        for b in batches:
            out = []
            for cell, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(tuple(r["genes"]), r["n"]) for r in rows]
                got = expectation_maximisation({g[0]: n for g, n in rows if len(g) == 1}, [r for r in rows if len(r[0]) > 1])
                out += [(cell, gene, value) for gene, value in got.items()]
            kinds = (pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["barcode", "gene", "value"])

    return cells.mapInArrow(deal, "barcode long, gene string, value double")


def zero_share(size: float, mu: float) -> float:
    return (size / (size + mu)) ** size


def fit_truncated(copies: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(size, mu) of the zero-truncated negative binomial of greatest likelihood, size within [1e-4, 1e4].

    For each size the mean fixes mu, by bisection; the size is found by golden-section search over its logarithm.
    """
    total = n.sum()
    mean = float((copies * n).sum() / total)
    if mean <= 1 + 1e-9:
        return 1e4, 1e-6
    log_fact = np.array([math.lgamma(c + 1) for c in copies])

    def mu_of(size: float) -> float:
        low, high = 1e-9, mean
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if mid / max(1 - zero_share(size, mid), 1e-300) < mean else (low, mid)
        return (low + high) / 2

    def loss(log_size: float) -> float:
        size = math.exp(log_size)
        mu = mu_of(size)
        rising = np.array([math.lgamma(c + size) for c in copies]) - math.lgamma(size)
        ll = rising - log_fact + size * math.log(size / (size + mu)) + copies * math.log(mu / (size + mu)) - math.log(max(1 - zero_share(size, mu), 1e-300))
        return -float((ll * n).sum())

    a, b, g = math.log(1e-4), math.log(1e4), (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = loss(c), loss(d)
    while b - a > 1e-6:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = loss(d)
    size = math.exp((a + b) / 2)
    return size, mu_of(size)


def predict(hist: DataFrame, t: float) -> DataFrame:
    """(gene, umis, size, mu, predicted, scale): molecules expected at ``t`` times the depth, never fewer than seen, and the gene's scale factor."""

    def gene(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("copies")
        copies, n = pdf["copies"].to_numpy(float), pdf["n"].to_numpy(float)
        if len(copies) == 1:  # a single value has no spread: a trace of its neighbours
            copies, n = np.array([copies[0], copies[0] + 1]), np.array([n[0], n[0] * 0.01])
        size, mu = fit_truncated(copies, n)
        seen = float(pdf["n"].sum())
        total = seen / max(1 - zero_share(size, mu), 1e-12)
        return pd.DataFrame([[pdf["gene"].iloc[0], seen, size, mu, max(seen, total * (1 - zero_share(size, mu * t)))]], columns=["gene", "umis", "size", "mu", "predicted"])

    fitted = hist.groupBy("gene").applyInPandas(gene, "gene string, umis double, size double, mu double, predicted double")
    sums = fitted.agg(F.sum("umis").alias("_u"), F.sum("predicted").alias("_p"))
    return fitted.crossJoin(F.broadcast(sums)).select("gene", "umis", "size", "mu", "predicted", (F.col("_u") / F.col("_p") * F.col("predicted") / F.col("umis")).alias("scale"))  # one row


def rescale(counts: DataFrame, predicted: DataFrame) -> DataFrame:
    """``counts`` (barcode, gene, value) times each gene's scale."""
    return counts.join(dictionary(predicted.select("gene", "scale")), "gene").select("barcode", "gene", (F.col("value") * F.col("scale")).alias("value"))
