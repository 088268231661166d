"""Operators on single texts against brute force, libraries and SQL."""

import hashlib
import json
import random
import re
from collections import Counter

import duckdb
import pytest

from terrasift.llm import bpe_tree, line_runs, pareto_mix, pii_bootstrap, quality_cascade, sql
from terrasift.llm.queries import tokenizer_path

WS = " \t\n\x0b\x0c\r"


def duck(name, rows):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, 'en', ?)", [(r[0], r[1], r[2] if len(r) > 2 else "a") for r in rows])
    rel = con.sql(sql.ORACLES[name])
    return rel.columns, rel.fetchall()


def test_bpe_is_the_library(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    lib, own = Tokenizer.from_file(path), bpe_tree.codec(open(path, encoding="utf-8").read())
    r = random.Random(7)
    bits = ["a", "é", "ß", " ", "  ", "\n", "\t", "'s", "'ll", "1", "²", "٣", "漢", "🙂", "́", "‍", "\x85", "\xa0", "\x1c", "\x00", "<|endoftext|>", "<|endof", "x" * 30, "THE", "　", "\r\n", "!!"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(500)] + ["", "ab" * 2000, " " * 500]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False) == t
    rows = [*enumerate(texts[:50]), (900, None)]
    got = {x.doc_id: x for x in bpe_tree.digests(docs(rows), path).collect()}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe_tree.decode(bpe_tree.encode(docs(rows), path), path)
    assert {x.doc_id: x.decoded for x in back.collect()} == {i: t or "" for i, t in rows}
    assert bpe_tree.digests(docs([]), path).count() == 0


def test_segment_tree_keeps_the_least_at_its_root():
    r = random.Random(3)
    for n in (1, 16, 17, 300, 5000):
        leaves = [r.randint(0, 50) * n + i for i in range(n)]
        tree = bpe_tree.RankTree(leaves)
        assert len(tree.rows[-1]) <= bpe_tree.FAN
        for _ in range(50):
            at = [r.randrange(n) for _ in range(3)]
            for i in at:
                leaves[i] = bpe_tree.NEVER * n if r.random() < 0.5 else r.randint(0, 50) * n + i
            tree.changed(*at)
            assert min(tree.rows[-1]) == min(leaves)


def test_files_that_ask_for_more_are_refused():
    spec = json.loads(open(tokenizer_path(), encoding="utf-8").read())
    bpe_tree.refuse_others(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}):
        with pytest.raises(ValueError):
            bpe_tree.refuse_others(spec | change)


def text_rows():
    r = random.Random(8)
    lines = ["Alpha beta", "  gamma\t", "GAMMA", "É", "é", "", "   ", "one two three four", "#tag $5 a|b", "x" * 300]
    rows = [(i, "\n".join(r.choice(lines) + (f" {r.randint(0, 30)}" if r.random() < 0.4 else "") for _ in range(r.randint(0, 12)))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, "\n"), (103, "same same same same"), (104, "a b c " * 200)]


def test_line_dedup(docs):
    rows = text_rows()
    key = lambda x: x.strip(WS).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    got = {r.doc_id: r for r in line_runs.digests(docs(rows)).collect()}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or seen[key(x)] < 10]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    columns, want = duck("op3_line_dedup", rows)
    assert sorted(tuple(got[r[0]][c] for c in columns) for r in want) == sorted(want)


def test_line_dedup_levels_and_repeats(docs):
    rows = [(1, "hot\nown")] * 6 + [(2, "hot")] * 4 + [(None, "hot\nx"), (3, "cold\ncold")]
    for batches in (1, 17):
        got = line_runs.without_shared_lines(docs(rows), n_batches=batches)
        assert Counter((r.doc_id, r.text, r.n_dropped) for r in got.collect()) == Counter({(1, "own", 1): 6, (2, "", 1): 4, (None, "x", 1): 1, (3, "cold\ncold", 0): 1})
    assert [c for c in got.columns if c not in ("n_lines", "n_dropped")] == docs(rows).columns
    assert line_runs.without_shared_lines(docs([])).count() == 0


def test_batches_meet_the_settled_run(spark, monkeypatch):
    """Nine batches: compactions on two levels, and later batches leave out what had settled before."""
    from pyspark.sql import functions as F

    made, written = [], []
    init = line_runs.SortedRuns.__init__
    monkeypatch.setattr(line_runs.SortedRuns, "__init__", lambda self, *a, **b: (made.append(self), init(self, *a, **b))[1])
    add = line_runs.SortedRuns.add

    def counting(self, counts):
        before = self.settled
        add(self, counts)
        written.append((before is not None, None if before is None else self._unsettled(counts).count(), counts.count()))

    monkeypatch.setattr(line_runs.SortedRuns, "add", counting)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("shared\n"), F.col("id").cast("string")).alias("text"))
    got = line_runs.without_shared_lines(docs)
    assert made[0].compactions == 4 and [len(x) for x in made[0].levels] == [0, 0, 1]
    assert [x[0] for x in written] == [False] * 3 + [True] * 6 and all(all_ - left == 1 for old, left, all_ in written if old)
    assert {r.text for r in got.collect()} == {str(i) for i in range(600)}


def shared_out(sizes):
    """Targets by the rule as it is told: share by weight, stop at three times, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        for s in open_:
            goal[s] += left * w[s] / total
        left = sum(max(0.0, goal[s] - 3 * sizes[s]) for s in open_)
        full = {s for s in open_ if goal[s] >= 3 * sizes[s]}
        for s in full:
            goal[s] = 3.0 * sizes[s]
        open_ -= full
    return goal


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 900, "c": 30, None: 65}, {"a": 10}, {"a": 0, "b": 7}, {chr(97 + i): 10 ** (i % 4) for i in range(9)}])
def test_targets_are_water_levels(spark, sizes):
    from pyspark.sql import functions as F

    sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").withColumn("root", F.lit(1).cast("long"))
    assert {r.source: r.target for r in pareto_mix.targets(sized).collect()} == pytest.approx(shared_out(sizes))


def test_mixing(docs):
    r = random.Random(9)
    rows = [(i, " ".join("w" * 3 for _ in range(int(r.paretovariate(1) * 20))), r.choice(["a", "b", "c", "d", None, "e"] if i > 40 else ["a"])) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "", "empty")]
    got = pareto_mix.allocated(docs(rows)).collect()
    columns, want = duck("op4_mixing", rows)
    shown = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted([tuple(shown(x[c]) for c in columns) for x in got]) == sorted([tuple(shown(v) for v in w) for w in want])
    size, goal = max(x.size for x in got), {x.source: x.target for x in got}
    sizes = {x.source: x.source_size for x in got}
    assert goal == pytest.approx(shared_out(sizes))
    for s in {x.source for x in got}:
        own = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= size / 2 + 1e-6 and own[0].target <= 3 * own[0].source_size + 1e-6
    assert all(x.taken <= 3 * x.size for x in got)
    again = pareto_mix.allocated(docs(rows[::-1])).collect()
    assert sorted((x.doc_id, x.taken) for x in again) == sorted((x.doc_id, x.taken) for x in got)
    copies = Counter(x.doc_id for x in pareto_mix.mixed(docs(rows)).collect())
    assert copies == Counter({x.doc_id: x.copies for x in got if x.copies})
    assert pareto_mix.allocated(docs([])).count() == 0
    twice = pareto_mix.mixed(docs([(1, "a b"), (1, "c d"), (1, "a b"), (None, "e")])).collect()
    assert sum(len(x.text.split()) for x in twice) in (6, 7, 8)


def test_quality(docs):
    rows = [*text_rows(), (200, " ".join(f"word{i}" for i in range(80))), (201, "| a | b " * 30), (202, " ".join(f"W{i}!!" for i in range(60)).upper())]
    got = quality_cascade.judged(docs(rows)).collect()
    columns, want = duck("op7_quality_rules", rows)
    assert sorted(tuple(x[c] for c in columns) for x in got) == sorted(want)
    kept = {x.doc_id for x in got if x.kept}
    assert 200 in kept and not {201, 202, 101} & kept
    figures = {r.__name__: (1.0, 0.1) for r in quality_cascade.RULES} | {"shouting": (0.1, 0.1), "symbols": (1.0, 0.0)}
    order = [r.__name__ for r in quality_cascade.ordered(quality_cascade.RULES, figures)]
    assert order[0] == "shouting" and order[-1] == "symbols"
    figures = {r.__name__: (10.0 if "looping" in r.__name__ else 1.0, 0.05 * (i + 1)) for i, r in enumerate(quality_cascade.RULES)}
    chosen = quality_cascade.ordered(quality_cascade.RULES, figures)
    assert quality_cascade.expected_seconds(chosen, figures) < 0.6 * quality_cascade.expected_seconds(list(quality_cascade.RULES), figures)
    assert max(x.rules_run for x in got) == len(quality_cascade.RULES) and min(x.rules_run for x in got) == 1
    assert quality_cascade.judged(docs([])).count() == 0


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 12 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d), "phone": lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15}
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(FORMS.items()) for m in re.finditer(p, text) if ok[k](m[0])]
    return sorted(found)


def test_base_spans(docs):
    r = random.Random(10)
    bits = ["a.b+c@d-e.org", "x@y", "@", "a@b.com_x@d.org.", "1.2.3.4", "256.1.1.1", "001.02.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713", "+1 (555) 123-4567", "+12", "é🙂", " ", "\n", "0", "9", ".", "-", "+49.30.1234567 ", "word", "%", "0000000000000000"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 25)))) for i in range(300)] + [(900, None), (901, ""), (902, "1 " * 30_000), (903, "a" * 30_000 + "@b.c"), (904, "1" * 20_000)]
    for x in pii_bootstrap.digests(docs(rows)).collect():
        want = base(dict(rows)[x.doc_id] or "")
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and {*text.split(",")} <= {*x.spans.split(","), ""}
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(w[3] == k for w in want) for k in FORMS]
    assert pii_bootstrap.digests(docs([])).count() == 0


def test_contexts_discover_identifiers(docs):
    rows = [(i, f"some words here then contact id: user{i}@mail.org and more words") for i in range(12)]
    rows += [(100, "before contact id: ZX-99812-77 after"), (101, "the order 12345678 was shipped"), (102, "the order 87654321 came")]
    got = {x.doc_id: x.spans for x in pii_bootstrap.digests(docs(rows)).collect()}
    assert got[100] == "id:19:30" and got[101] == got[102] == ""
    assert got[3] == "email:33:47"


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_sql_reads(name):
    assert duck(name, [(1, "a b"), (2, None)])[1]
