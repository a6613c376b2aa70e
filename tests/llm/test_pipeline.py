import corpus_pipeline
from mascate.llm.frames import written
from mascate.llm.queries import ORACLES, QUERIES

from .fixtures import odd, table

PASSAGE = " ".join(f"passage{n}" for n in range(55))


def rows():
    out = [(n, " ".join(f"d{n}w{m}" for m in range(40)), "en", f"s{n % 3}", 0) for n in range(30)]
    out += [(100 + n, f"{PASSAGE}\n" + " ".join(f"p{n}w{m}" for m in range(30)), "en", "s1", 0) for n in range(4)]
    out += [(200, out[0][1], "en", "s0", 0), (201, out[1][1] + " more", "en", "s0", 0)]
    out += [(300, "too short", "en", "s2", 0), (301, "again and again and over " * 30, "en", "s2", 0)]
    return out


def test_each_stage_takes_effect(spark):
    docs = table(spark, rows())
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    columns = docs.columns
    good, lines, near, mixed, encoded = [stage for _, stage in corpus_pipeline.STAGES]
    docs = written(good(spark, docs, ""))
    assert docs.columns == columns and set(ids(docs)) == {r[0] for r in rows()} - {300, 301}
    docs = written(lines(spark, docs, ""))
    assert docs.columns == columns and 200 not in ids(docs)
    holders = [r["doc_id"] for r in docs.collect() if PASSAGE in r["text"]]
    assert holders == [100]
    before = ids(docs)
    docs = written(near(spark, docs, ""))
    assert docs.columns == columns and set(before) - set(ids(docs)) == {201}
    docs = written(mixed(spark, docs, ""))
    assert docs.columns == columns and 0 < len(ids(docs)) <= 35 and len(set(ids(docs))) == len(ids(docs))
    tokens = encoded(spark, docs, "")
    assert ids(tokens) == ids(docs) and all(r["n_tokens"] > 0 for r in tokens.collect())


def test_run_writes_between_stages(spark, tmp_path):
    table(spark, rows()).write.parquet(str(tmp_path / "documents.parquet"))
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).count() <= 35


def test_odd_rows_pass_all_stages(spark):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""))
        assert docs.columns == odd(spark).columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_an_operator_of_each_number_is_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES)
