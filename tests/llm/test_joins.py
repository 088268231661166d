"""Near-duplicate operators against brute force."""

import random

import numpy as np
import pytest

from terrasift.llm import fingerprints, jaccard_join
from terrasift.llm.common import shingles


def sets_of(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, num, den):
    sets = [(r[0], sets_of(r[1], k)) for r in rows if r[0] is not None]
    lead = {i: i for i, _ in sets}

    def top(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((top(a), top(b)))
                lead[q] = p
    return {i: top(i) for i, _ in sets}


def corpus(seed, n=160):
    """Texts of many sizes, families of edited copies around the threshold, a shared passage, short texts."""
    r = random.Random(seed)
    word = lambda: "w" + str(r.randint(0, 3000))
    passage, out = [word() for _ in range(40)], []
    for _ in range(n // 8):
        base = [word() for _ in range(r.choice([3, 5, 8, 12, 20, 40, 90, 200]))]
        if r.random() < 0.5:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(r.randint(2, 12)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 20))):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:
                copy = copy[: int(len(copy) * r.uniform(0.8, 1))]
            out.append(" ".join(copy))
    out += ["", " \n ", "a", "A", "a b", "a b c d e", "A  b\tc d e", " ".join(passage)]
    ids = r.sample(range(10_000), len(out))
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 4, 85), (2, 5, 80)])
def test_join_is_exact(docs, seed, k, num):
    rows = [*corpus(seed), (20_000, None), (None, "a b c d e f")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.joined(docs(rows), k, num, 100).collect()}
    want = brute(rows, k, num, 100)
    assert {i: c for i, (_, c) in got.items() if i is not None} == want
    assert got[None] == (len(sets_of("a b c d e f", k)), None) and got[20_000][0] == 0
    assert all(got[i][0] == len(sets_of(t, k)) for i, t in rows if i is not None)


def test_matrix_round_alone_is_exact(docs, monkeypatch):
    """Without the stars every link is left to the token-group matrix."""
    monkeypatch.setattr(jaccard_join, "_star_links", lambda d, tokens, order, k, scheme: tokens.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", 3 * jaccard_join.LEAST_TOKENS)
    monkeypatch.setattr(jaccard_join, "BUNDLE_GROUPS", 4)
    rows = corpus(3, 80)
    got = {r.doc_id: r.component_id for r in jaccard_join.joined(docs(rows), 4, 85, 100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_sets_do_not_move_to_pick_one_of_each_class(docs, monkeypatch):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{r.randint(0, 2000)}" for _ in range(r.choice([3, 20, 80])))) for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(100, rows[0][1]), (3, rows[9][1]), (200, ""), (None, rows[1][1])]
    want, plans, real = brute(rows, 5, 80, 100), [], jaccard_join.shared_tokens

    def shared_tokens(reps):
        plans.append(reps._jdf.queryExecution().executedPlan().toString())
        return real(reps)

    monkeypatch.setattr(jaccard_join, "shared_tokens", shared_tokens)
    # The rows to keep, the rows to leave out, and neither can be broadcast.
    for most, moves in ((1000, False), (20, False), (2, True)):
        monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", most)
        plans.clear()
        got = {x.doc_id: x.component_id for x in jaccard_join.joined(docs(rows)).collect() if x.doc_id is not None}
        assert all(got[i] == c for i, c in want.items()) and set(got) == set(want)
        assert ("Exchange hashpartitioning" in plans[0]) <= moves


def test_scheme_never_loses_a_pair():
    """A linked pair shares as many tokens of one class as both of its documents ask for."""
    r = np.random.default_rng(5)
    for num in (80, 85):
        scheme = jaccard_join.Scheme(num, 100)
        for _ in range(300):
            n = int(r.integers(1, 400))
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            keep = a[r.random(len(a)) > r.uniform(0, 0.2)]
            b = np.unique(np.concatenate([keep, r.integers(0, 2**63, int(len(a) * r.uniform(0, 0.1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < num * (len(a) + len(b) - both) or len(a) == len(b) == both:
                continue
            x, y = ({p["meta"] // jaccard_join.META: p for p in scheme.parts(s)} for s in (a, b))
            hits = [len(np.intersect1d(x[c]["tokens"], y[c]["tokens"])) >= max(x[c]["meta"] % jaccard_join.META, y[c]["meta"] % jaccard_join.META) for c in x.keys() & y.keys()]
            assert any(hits)


def test_one_of_each(docs):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l"), (3, "h i j k l"), (4, None), (5, ""), (None, "z"), (None, "z")]
    got = jaccard_join.one_of_each(docs(rows))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "4", "5", "None", "None"] and got.columns == docs(rows).columns
    assert jaccard_join.joined(docs([])).count() == 0


def test_fingerprints_along_descending_ids(docs):
    rows = [*corpus(4, 60), (20_001, None), (20_002, "é" * 7)]
    got = {r.doc_id: r for r in fingerprints.with_next(docs(rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    import hashlib

    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = (fingerprints.of_text(x.encode()) for x in (t, e, after))
        assert (r.fingerprint, r.edited_fingerprint) == (a.hex(), b.hex())
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    one = fingerprints.with_next(docs([(1, "abcd")])).first()
    assert one.near_next == 1 and one.n_chars == 4
    assert fingerprints.with_next(docs([])).count() == 0
    assert fingerprints.with_next(docs([(1, "a b"), (1, "a b"), (None, "c")])).count() == 3


def slow_fingerprint(text, bins=512, bits=4):
    """A dictionary of bins, and each empty one asking the others in its order, one after the other."""
    least = {}
    for h in shingles((text or "").encode(), 5).tolist():
        least[h >> 55] = min(h, least.get(h >> 55, h))
    if not least:
        return ""
    digits = ""
    for i, order in enumerate(fingerprints.orders().tolist()):
        value = least[i] if i in least else next(least[j] for j in order if j in least)
        digits += f"{value % 2**bits:x}"
    assert len(digits) == bins
    return digits


def test_fingerprints_are_those_of_a_plain_loop(docs):
    rows = [*corpus(9, 40), (30_000, "word " * 3000 + "é"), (30_001, None), (30_002, "a b")]
    got = {r.doc_id: r for r in fingerprints.with_next(docs(rows)).collect()}
    for i, t in rows:
        assert got[i].fingerprint == slow_fingerprint(t)
    a, b = slow_fingerprint(rows[0][1]), slow_fingerprint(rows[1][1])
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 512
    assert fingerprints.likeness(bytes.fromhex(a), bytes.fromhex(b)) == pytest.approx(min(1, max(0, (same - 1 / 16) / (15 / 16))))


def test_fingerprints_as_a_column(docs):
    from pyspark.sql import functions as F

    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, "")]
    out = fingerprints.fingerprinted(docs(rows).withColumn("fingerprint", F.lit("clash")))
    assert out.columns == [*docs(rows).columns, "fingerprint"]
    assert sorted((r.doc_id or 0, r.fingerprint.hex()) for r in out.collect()) == sorted((i or 0, slow_fingerprint(t)) for i, t in rows)
    assert fingerprints.fingerprinted(docs([])).count() == 0


def test_fingerprints_estimate_jaccard():
    r = random.Random(6)
    off = []
    for _ in range(60):
        n = r.choice([30, 200, 900])
        base = ["w" + str(r.randint(0, 10**6)) for _ in range(n)]
        cut = r.randint(0, n)
        other = base[:cut] + ["v" + str(r.randint(0, 10**6)) for _ in range(n - cut)]
        a, b = " ".join(base), " ".join(other)
        x, y = (set(shingles(t.encode(), 5).tolist()) for t in (a, b))
        off.append(abs(len(x & y) / len(x | y) - fingerprints.likeness(fingerprints.of_text(a.encode()), fingerprints.of_text(b.encode()))))
    assert np.mean(off) < 0.03 and max(off) < 0.12
    assert fingerprints.likeness(b"", b"") == 1 and fingerprints.likeness(b"", fingerprints.of_text(b"a")) == 0
