"""Counts of one pass over a history, from which the change layer, the defect layer and what follows what are all made.

history is (commit_id, own, ts, file, amount, fixed) and columns to order by: a row for each line of a commit, in which a file
may come several times, and one (own, with ts) for each commit that is known.  A file is its name or a number that stands for
it, which takes less room on its way.  The history is shuffled once, by commit; a task counts in blocks of whole commits, so
counts are all that is shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Lines that are counted at a time, and the rest of the last commit.
BLOCK = 1 << 19
#: What a row is, beside an ordinary line: a commit's own, or a line that fixes.
OWN, FIXED = 1, 2


def tallies(history: DataFrame, max_files: int, *order: str) -> DataFrame:
    """(kind, a, b, cnt, churn, ts): how often and how much; a and b are of file's type.

    touch: file a changed, churn by how much and ts when last.  fix: file a was fixed.  pair: a < b changed in one commit.
    fault: a changed where b was fixed.  next: b's line came right after one of a, which isn't b.  Pairs and faults are of
    known commits with at most max_files files, touches of all known ones, fixes and nexts of all.
    """
    ship_package(history.sparkSession)
    kinds = dict(history.dtypes)

    def run(batches: Iterator) -> Iterator:
        for block in whole_commits(batches, BLOCK):
            yield from counts(block, max_files).to_batches()

    marks = F.when(F.col("own"), OWN).when(F.col("fixed"), FIXED).otherwise(0).cast("byte")
    sorted_ = history.withColumn("marks", marks).drop("own", "fixed").repartition("commit_id").sortWithinPartitions("commit_id", *order)
    counted = sorted_.select("commit_id", "marks", "ts", "file", "amount").mapInArrow(run, f"kind string, a {kinds['file']}, b {kinds['file']}, cnt long, churn long, ts {kinds['ts']}")
    return counted.groupBy("kind", "a", "b").agg(F.sum("cnt").alias("cnt"), F.sum("churn").alias("churn"), F.max("ts").alias("ts"))


def _starts(commits) -> object:
    """Where a commit begins; a null is a commit of its own."""
    import numpy as np

    null = commits.is_null().to_numpy(zero_copy_only=False)
    key = commits.fill_null(0).to_numpy()
    return np.r_[True, (key[1:] != key[:-1]) | (null[1:] != null[:-1])]


def whole_commits(batches: Iterator, block: int) -> Iterator:
    """Tables of at least `block` rows, but the last, that end where a commit does."""
    import numpy as np
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= block:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_starts(table["commit_id"].combine_chunks()))[-1])
            if last:
                yield table.slice(0, last)
            held = table.slice(last).to_batches()
            n = 0  # a commit of more rows than a block isn't looked through again at every batch
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def counts(table: object, max_files: int) -> object:
    """The tallies of whole commits in their order, as a table."""
    import numpy as np
    import pyarrow as pa

    column = lambda name: table[name].combine_chunks()
    commit = np.cumsum(_starts(column("commit_id"))) - 1
    marks = column("marks").to_numpy()
    own = marks == OWN
    known = np.bincount(commit, own) > 0
    stamps = column("ts")
    never = np.iinfo(np.int64).min
    when = np.full(len(known), never)
    np.maximum.at(when, commit[own], stamps.cast(pa.int64()).fill_null(never).to_numpy()[own])

    # files as numbers in their order, -1 for none
    coded = column("file").dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), dtype=object)
    ranks = np.empty(len(names), np.int64)
    ranks[np.argsort(names)] = np.arange(len(names))
    size = len(names) + 1
    files = pa.array(np.sort(names), coded.dictionary.type)
    code = coded.indices.fill_null(-1).to_numpy().astype(np.int64)
    code = np.where(code < 0, -1, ranks[code] if len(names) else -1)[~own]
    commit = commit[~own]
    amounts = column("amount").filter(pa.array(~own))
    some, amount = amounts.is_valid().to_numpy(zero_copy_only=False), amounts.fill_null(0.0).to_numpy()
    fixed = marks[~own] == FIXED

    out = []

    def add(kind: str, a, b, cnt, churn=None, ts=None) -> None:
        k, none = len(cnt), np.full(len(cnt), -1)
        take = lambda x: files.take(pa.array(x, mask=x < 0))
        churn = pa.nulls(k, pa.int64()) if churn is None else churn
        ts = pa.nulls(k, stamps.type) if ts is None else pa.array(ts, mask=ts == never).cast(stamps.type)
        out.append(pa.table([pa.array([kind] * k, pa.string()), take(a), take(none if b is None else b), pa.array(cnt, pa.int64()), churn, ts], ["kind", "a", "b", "cnt", "churn", "ts"]))

    def add_pairs(kind: str, keys: list) -> None:
        key, cnt = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_counts=True)
        add(kind, key // size, key % size, cnt)

    follows = np.flatnonzero((commit[1:] == commit[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0) & (code[1:] != code[:-1]))
    add_pairs("next", [code[follows] * size + code[follows + 1]])

    # touches: a row for each file of a commit, in the files' order
    place = commit * size + code + 1
    by = np.argsort(place, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(place[by]) != 0]) if len(by) else by
    if not len(at):
        return pa.concat_tables(out)
    commit, code = commit[by][at], code[by][at]
    fixed = np.logical_or.reduceat(fixed[by], at)
    some = np.logical_or.reduceat(some[by], at)
    churn = np.add.reduceat(amount[by], at).astype(np.int64)
    live = known[commit]
    cnt, any_ = np.bincount(code[live] + 1, minlength=size), np.bincount(code[live & some] + 1, minlength=size) > 0
    total, last = np.zeros(size, np.int64), np.full(size, never)
    np.add.at(total, code[live] + 1, churn[live])
    np.maximum.at(last, code[live] + 1, when[commit[live]])
    has = np.flatnonzero(cnt)
    add("touch", has - 1, None, cnt[has], churn=pa.array(total[has], mask=~any_[has]), ts=last[has])
    bugs = np.bincount(code[fixed] + 1, minlength=size)
    has = np.flatnonzero(bugs)
    add("fix", has - 1, None, bugs[has])

    small = live & (np.bincount(commit, minlength=len(known)) <= max_files)[commit]
    pairs, faults = [], []
    for k in range(1, max_files):
        i = np.flatnonzero(small[:-k] & (commit[k:] == commit[:-k]) & (code[:-k] >= 0))
        if not len(i):
            break
        ahead, back = code[i] * size + code[i + k], code[i + k] * size + code[i]
        pairs.append(ahead)
        faults += [ahead[fixed[i + k]], back[fixed[i]]]
    add_pairs("pair", pairs)
    add_pairs("fault", faults)
    return pa.concat_tables(out)


def frequencies(tally: DataFrame) -> DataFrame:
    """As change.frequencies."""
    rows = tally.where("kind = 'touch'").select(F.col("a").alias("file"), F.col("cnt").alias("change_freq"), F.col("churn").alias("churn_lines"), F.col("ts").cast("string").alias("last_changed"))
    return rows.withColumn("churn_rate", F.when(F.col("change_freq") > 0, F.col("churn_lines") / F.col("change_freq")).otherwise(0.0))


def pairs(tally: DataFrame) -> DataFrame:
    """As change.co_change_pairs."""
    return tally.where("kind = 'pair'").select("a", "b", "cnt")


def fault_times(tally: DataFrame) -> DataFrame:
    """(source, target, cnt)."""
    return tally.where("kind = 'fault'").select(F.col("a").alias("source"), F.col("b").alias("target"), "cnt")


def bugs(tally: DataFrame) -> DataFrame:
    """(file, bug_count)."""
    return tally.where("kind = 'fix'").select(F.col("a").alias("file"), F.col("cnt").alias("bug_count"))


def follows(tally: DataFrame) -> DataFrame:
    """(source, target, cnt)."""
    return tally.where("kind = 'next'").select(F.col("a").alias("source"), F.col("b").alias("target"), "cnt")


def named(tally: DataFrame, names: DataFrame) -> DataFrame:
    """The tally with names in place of numbers; names is (file, name).  A pair's names are put in their order."""
    for end in ("a", "b"):
        tally = tally.join(names.toDF(end, f"_{end}"), end, "left")
    swap = (F.col("kind") == "pair") & (F.col("_a") > F.col("_b"))
    a, b = F.when(swap, F.col("_b")).otherwise(F.col("_a")), F.when(swap, F.col("_a")).otherwise(F.col("_b"))
    return tally.select("kind", a.alias("a"), b.alias("b"), "cnt", "churn", "ts")
