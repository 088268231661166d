"""The pipeline's stages: what each keeps of its own input, by brute force."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_joins import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, frames = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
    for name in list(kept)[:-1]:
        assert kept[name].columns == COLUMNS
    before = {r.doc_id: r.text for r in frames["line_dedup"].collect()}
    low = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = Counter(k for t in before.values() for k in {low(x) for x in t.split("\n")})
    want = {}
    for i, t in before.items():
        lines = [x for x in t.split("\n") if not low(x) or seen[low(x)] < 10]
        if len(lines) == len(t.split("\n")) or "\n".join(lines).strip(" \t\n\x0b\x0c\r"):
            want[i] = "\n".join(lines)
    got = {r.doc_id: (r.text, r.n_chars) for r in kept["line_dedup"].collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    lead = brute(list(want.items()), 5, 80, 100)
    assert {r.doc_id for r in kept["ngram_jaccard_join"].collect()} == {i for i, c in lead.items() if i == c}
    mix = Counter(r.doc_id for r in kept["mixing"].collect())
    assert max(mix.values()) <= 3 and set(mix) <= set(want)
    assert Counter(r.doc_id for r in kept["bpe"].collect()) == mix


def test_run_and_edges(spark, docs):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    odd = docs([(1, None), (2, ""), (None, "x y z"), (3, "a b c"), (3, "a b c")]).drop("n", "token")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, SF)
        assert odd.columns == COLUMNS
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()


def test_copies_reach_the_join_and_no_row_is_lost(spark, docs):
    copy = "a line of the copies\nand another one of them"
    rows = [(i, copy + ("" if i % 2 else " \n")) for i in range(24)]
    rows += [(100 + i, f"Boilerplate\nown words of text {i}") for i in range(12)] + [(200, "boilerplate"), (201, ""), (202, None)]
    given = docs(rows).drop("n", "token")
    out = {r.doc_id: r for r in corpus_pipeline.drop_shared_lines(spark, given, SF).collect()}
    assert set(out) == {r[0] for r in rows}
    assert all(out[i].text == t and out[i].n_chars == len(t) for i, t in rows[:24])
    assert all((out[100 + i].text, out[100 + i].n_chars) == (f"own words of text {i}", len(f"own words of text {i}")) for i in range(12))
    assert (out[200].text, out[200].n_chars, out[201].text, out[202].text) == ("", 0, "", None)
    left = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(list(out.values()), given.schema), SF)
    assert [r.doc_id for r in left.collect() if r.doc_id < 24] == [0]
