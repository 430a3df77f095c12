"""Conversation repair, decontamination and periodic runs against brute force and SQL, over awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.llm import conversation_repair as cr
from inkgrid.llm import decontamination as dc
from inkgrid.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Conversations.


def all_splits(leaves):
    """The whole chart: every span, every split."""
    n = len(leaves)
    chart = {(i, i + 1): leaf for i, leaf in enumerate(leaves)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cells = [cr.combined(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)]
            chart[i, i + size] = tuple(tuple(cr.least(*[c[p][q] for c in cells]) for q in cr.STATES) for p in cr.STATES)
    return chart[0, n]


def cheapest(rows):
    """Cheapest cost and audit over every edit list with at most two insertions in a place; "?" may be user or assistant."""
    best = []
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("KRD", repeat=len(rows)):
            if any(doomed and e != "D" for (_, _, doomed), e in zip(rows, edits, strict=True)):
                continue
            cost, audit, roles = 3 * sum(inserts), "I" * inserts[0], ["?"] * inserts[0]
            for (initial, cut, _), e, more in zip(rows, edits, inserts[1:], strict=True):
                cost += {"K": 0, "R": 3, "D": 4}[e] + 3 * (cut and e != "D")
                audit += e + "I" * more
                roles += {"K": [initial], "R": ["?"], "D": []}[e] + ["?"] * more
            body = roles[1:] if roles[:1] == ["s"] else roles
            if len(body) % 2 == 0 and all(x in ("?", "ua"[i % 2]) for i, x in enumerate(body)) and (body or not roles):
                best.append((cost, audit))
    return min(best)


def test_cells_against_all_edit_lists():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.random() < 0.3, rng.random() < 0.25) for _ in range(rng.randint(1, 3))]
        rows = [(i, cut and not doomed, doomed) for i, cut, doomed in rows]
        cells = [cr.leaf(*r) for r in rows]
        cost, pieces = cr.chosen(cells)
        assert (cost, "".join(a for _, a in pieces)) == cheapest(rows)


def test_one_split_a_span_is_enough():
    rng = random.Random(2)
    for _ in range(40):
        leaves = [cr.leaf(rng.choice("suax"), rng.random() < 0.3, rng.random() < 0.2) for _ in range(rng.randint(1, 12))]
        whole = all_splits(leaves)
        assert cr.parsed(leaves) == whole
        cuts = sorted(rng.sample(range(1, len(leaves)), min(3, len(leaves) - 1)))
        parts = [leaves[a:b] for a, b in zip([0, *cuts], [*cuts, len(leaves)], strict=True)]
        cost, pieces = cr.chosen([cr.parsed(p) for p in parts])
        assert (cost, pieces) and cr.chosen([whole])[0] == cost and cr.chosen([whole])[1][0][1] == "".join(a for _, a in pieces)


def turn_rows():
    rng = random.Random(5)
    rows = []
    for c in range(40):
        for t in range(rng.choice([1, 2, 3, 6, 25])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            rows.append((c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 2]), role, rng.choice(["Yes.", "no", "", " \t", "What?", "é!", "ok.\n ", f"text {rng.random()}."])))
    rows += [(100, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(400)]
    rows += [(101, 1, "user", "same.")] * 50 + [(102, None, None, None), (None, 3, "user", "null id."), (None, None, "assistant", "x")]
    rows += [(103, 2, "user", "long " * 20000 + "."), (103, 1, "system", "s.")]
    return rows


def repaired_by_hand(rows):
    """Row by row, left to right, over whole edit lists of each state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        blank = not WORD.search(text)
        twice = not blank and (role, text) in seen
        cut = not blank and not twice and text.rstrip("\x20\t\n\x0b\x0c\r")[-1] not in ".!?"
        seen.add((role, text))
        faults.append((blank, twice, cut))
    close = lambda d: {q: min([v for v in [d.get(q), *[(d[p][0] + 3 * k, d[p][1] + "I" * k, d[p][2] + more) for p, q2, k, more in [(0, 2, 1, (("user", ""),)), (0, 3, 2, (("user", ""), ("assistant", ""))), (1, 2, 1, (("user", ""),)), (1, 3, 2, (("user", ""), ("assistant", ""))), (2, 3, 1, (("assistant", ""),)), (3, 2, 1, (("user", ""),))] if q2 == q and p in d]] if v]) for q in range(4) if q in d or q > 1}
    state = close({0: (0, "", ())})
    for (_, _, role, text), (blank, twice, cut) in zip(rows, faults, strict=True):
        new = {p: (c + 4, a + "D", out) for p, (c, a, out) in state.items()}
        if not blank and not twice:
            for p, (c, a, out) in state.items():
                for r, leads in (("system", {0: 1}), ("user", {0: 2, 1: 2, 3: 2}), ("assistant", {2: 3})):
                    if p in leads:
                        ways = ([(0, "K", role)] if role[:1] == r[0] else []) + ([(3, "R", r)] if r != "system" else [])
                        for cost, e, name in ways:
                            way = (c + cost + 3 * cut, a + e, (*out, (name, text)))
                            new[leads[p]] = min(new.get(leads[p], way), way)
        state = close(new)
    cost, audit, out = min(state[q] for q in (0, 3) if q in state)
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows[:-1], rows[1:], strict=True))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *[sum(f[i] for f in faults) for i in range(3)], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("rows_a_stretch", [3, 2048])
def test_conversations_by_hand(spark, monkeypatch, rows_a_stretch):
    """Nulls, ties, repeated rows, conversations over many tasks and stretches, extra columns."""
    monkeypatch.setattr(cr, "ROWS", rows_a_stretch)
    rows = turn_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit(7)).withColumn("stretch", F.lit("x")).repartition(3)
    found = cr.repair(table)
    got = {r["conv_id"]: r for r in found.summary.join(cr.digests(found.turns).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").collect()}
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((c, t, " " if r is None else r, " " if x is None else x))
    assert set(got) == set(groups)
    for c, g in groups.items():
        r = got[c]
        assert (*[r[k] for k in cr.COUNTS], r["audit"], r["repaired_sha256"] or hashlib.sha256(b"").hexdigest()) == repaired_by_hand(g), c


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = cr.repair(cr.damaged(none))
    assert found.summary.count() == 0 and cr.digests(found.turns).count() == 0


# Decontamination.


def leak_rows():
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 4, 9, 10, 11, 30])))) for i in range(30)]
    items += [(2, items[5][1]), (7, None), (8, ""), (9, "?! --"), (None, " ".join(rng.choices(vocab, k=14))), (300, "hot " * 12), (40, "Été, ÉTÉ")]
    items.append((500, " ".join(rng.choices(vocab, k=9000))))
    docs = []
    for i in range(50):
        words = rng.choices(vocab, k=rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1] or ""
            part = item.split()
            a = rng.randrange(max(1, len(part)))
            words[rng.randint(0, len(words)) : 0] = part[a : a + rng.choice([8, 10, 12, 60])]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    docs += [(50, None), (51, ""), (None, items[0][1]), (52, "hot " * 5000), (5, docs[5][1]), docs[6], (53, "Été, ÉTÉ!")]
    return docs, items


def leaks_by_hand(docs, items, near):
    out = []
    wins = []
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        n = min(10, len(w))
        wins += [(item, w[a : a + n]) for a in range(len(w) - n + 1)] if w else []
    keyed = {}
    for item, w in wins:
        keyed.setdefault(tuple(w), set()).add(item)
    sizes = {len(w) for w in keyed}
    for doc, text in docs:
        d = ALNUM.findall((text or "").translate(LOWER))
        hit, found, close = set(), set(), set()
        for n in sizes:
            for i in range(len(d) - n + 1):
                own = keyed.get(tuple(d[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        stretches = [frozenset(d[i : i + near]) for i in range(len(d))]
        held = set(d)
        for w, own in keyed.items():
            if held.issuperset(w) and any(s.issuperset(w) for s in set(stretches)):
                close |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(d), len(hit), len(ids), ",".join(ids), bool(hit), len(close - {None})))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [(1 << 21, 4096, 1 << 18), (400, 16, 64)])
def test_leaks_by_hand(spark, monkeypatch, limits):
    """One segment and block, or many of each, give the same."""
    for name, value in zip(("SEGMENT", "PIECE", "BLOCK"), limits, strict=True):
        monkeypatch.setattr(dc, name, value)
    docs, items = leak_rows()
    if limits[2] < 1000:
        items = [x for x in items if x[0] != 500]
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n_hit int, item string").repartition(3)
    found = dc.contamination(table, spark.createDataFrame([(*i, "k") for i in items], "item_id long, text string, words string"))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"], r["n_near"]) for r in found.collect()]
    assert sorted(got, key=repr) == leaks_by_hand(docs, items, dc.NEAR)


def test_no_leaks(spark):
    docs, items = spark.createDataFrame([(1, "one two")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in dc.contamination(docs, items).collect()] == [(1, 2, 0, 0, [], False, 0)]
    assert dc.contamination(docs.limit(0), spark.createDataFrame([(1, "one")], "item_id long, text string")).count() == 0


# Periodic runs.


def runs_by_hand(w):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, q, n) for (i, n), q in best.items())


def test_runs_by_hand(spark):
    rng = random.Random(7)
    rows = [(None, None, 1), (1, "", 2), (2, " \n", 3), (3, "one", 4), (4, "a " * 5000, 5), (5, "a\tb\x0bé " * 6, 6)]
    for i in range(6, 120):
        words = []
        while len(words) < rng.choice([10, 40, 200]):
            block = rng.choices([f"w{k}" for k in range(rng.choice([1, 2, 5, 80]))], k=rng.choice([1, 2, 3, 7, 20]))
            words += block * rng.choice([1, 2, 5]) + block[: rng.randrange(len(block))]
        rows.append((i, rng.choice([" ", "\n ", "\t"]).join(words) + rng.choice(["", "  "]), i))
    rows += [rows[-1]]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    found = periodic.periodic_runs(table)
    assert found.columns == ["doc_id", "runs", "n_words", "runs_", "collapsed"]
    got = Counter((r["doc_id"], r["runs"], r["n_words"], tuple((x["start"], x["period"], x["length"]) for x in r["runs_"]), r["collapsed"]) for r in found.collect())
    want = Counter()
    for doc, text, k in rows:
        w = WORD.findall(text or "")
        runs = runs_by_hand(w)
        gone = {i for s, q, n in runs for i in range(s + q, s + n)}
        want[doc, k, len(w), tuple(runs), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    assert got == want
    assert periodic.periodic_runs(table.limit(0)).count() == 0


def test_splitting_leaves_few_words():
    """Words of random text hardly survive; one long period does, whatever its length."""
    rng = np.random.default_rng(3)
    vocab = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    plain = vocab[rng.integers(0, 5000, 3000)]
    assert periodic.segments(plain, np.zeros(3000, int))[1].sum() < 300
    long = np.tile(vocab[rng.integers(0, 5000, 20000)], 3)
    start, length, period = periodic.find_runs(long, np.zeros(60000, int))
    assert (0, 60000, 20000) in set(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
