import numpy as np
import pytest

from mascate.llm import mixing

from .fixtures import ODD, empty, odd, table


def brute_rake(cells, targets, share, bound, rounds=2000):
    """Iterative proportional fitting of {(source, lang, topic): tokens} under a bound, in plain Python."""
    total = sum(cells.values())
    expected = dict.fromkeys(cells, share)
    for _ in range(rounds):
        for d in range(3):
            for value, part in targets[d].items():
                own = [key for key in cells if key[d] == value]
                given = sum(cells[key] * expected[key] for key in own)
                whole = sum(cells[key] * expected[key] for key in own if bound and expected[key] >= bound)
                wanted = part * total * share
                factor = wanted / given if wanted <= given else (wanted - whole) / (given - whole) if given > whole else 1
                for key in own:
                    expected[key] = min(bound or 1e300, expected[key] * factor)
    return expected


@pytest.mark.parametrize("share, bound, few", [(0.3, None, 99), (0.3, 1.0, 99), (0.8, 1.0, 99), (0.3, 1.0, 0)])
def test_rake_matches_plain_fitting(spark, monkeypatch, share, bound, few):
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    rng = np.random.default_rng(1)
    cells = {(f"s{s}", f"l{l}", f"t{t}"): float(rng.integers(1, 100)) for s in range(4) for l in range(3) for t in range(2)}
    frame = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens double")
    targets = [{f"s{n}": v for n, v in enumerate((0.1, 0.2, 0.3, 0.4))}, {"l0": 0.5, "l1": 0.25, "l2": 0.25}, {"t0": 0.7, "t1": 0.3}]
    given = dict(zip(mixing.DIMENSIONS, targets, strict=True))
    raked = mixing.rake(frame, given, share=share, bound=bound).collect()
    got = {(r["source"], r["lang"], r["topic"]): r["expected"] for r in raked}
    expected = brute_rake(cells, targets, share, bound)
    assert all(abs(got[k] - v) < 2e-3 * max(v, 1) for k, v in expected.items())
    assert all(r["moved"] <= mixing.TOLERANCE for r in raked)
    if bound:
        assert max(got.values()) <= bound
    total = sum(cells.values())
    sums = {v: sum(got[k] * cells[k] for k in cells if v in k) / total / share for v in ("t0", "t1", "l1")}
    if share == 0.3:
        # the bound leaves room for all marginals
        assert abs(sums["t0"] - 0.7) < 1e-3 and abs(sums["t1"] - 0.3) < 1e-3 and abs(sums["l1"] - 0.25) < 1e-3


def test_unmet_targets_are_told(spark):
    # small has a ninth of the tokens and is asked for half of them
    rows = [(n, f"text number {n} " + "w " * 20, "en", "big" if n % 9 else "small", 0) for n in range(1800)]
    targets = {"source": {"big": 0.5, "small": 0.5}, "lang": {"en": 1.0}, "topic": {"note": 1.0}}
    for share, met in ((0.8, False), (0.2, True)):
        mixed = mixing.mix(table(spark, rows), targets=targets, share=share)
        told = {(r["dimension"], r["value"]): r for r in mixing.shares(mixed, targets).collect()}
        assert told["source", "small"]["met"] is met and told["lang", "en"]["met"]
        assert mixed.where("copies > 1").count() == 0
        small = mixed.where("source = 'small'").agg({"probability": "min"}).first()[0]
        assert small == 1.0 if not met else small < 1.0


def test_sampling_follows_probabilities(spark):
    rows = [(n, f"text number {n} " + "w " * 20, "en", "big" if n % 10 else "small", 0) for n in range(4000)]
    mixed = mixing.mix(table(spark, rows), targets={"source": {"big": 0.5, "small": 0.5}}, share=0.4).select(
        "source", "probability", "sampled"
    ).toPandas()
    for _, part in mixed.groupby("source"):
        assert abs(part["sampled"].mean() - part["probability"].iloc[0]) < 0.05
    assert mixed[mixed.source == "small"].probability.iloc[0] == 1.0


def test_targets_are_reached_where_cells_have_too_little(spark):
    # a ninth of the tokens is to be half of the sample, and German two thirds of it
    rows = [(n, f"text number {n} " + "w " * 20, "de" if n % 4 else "en", "big" if n % 9 else "small", 0) for n in range(3600)]
    docs = table(spark, rows)
    targets = {"source": {"big": 0.5, "small": 0.5}, "lang": {"de": 2 / 3, "en": 1 / 3}, "topic": {"note": 1.0}}
    mixed = mixing.mix(docs, targets=targets, share=0.8, repeats=True)
    for row in mixing.shares(mixed, targets).collect():
        assert row["target"] == targets[row["dimension"]][row["value"]]
        assert abs(row["expected"] - row["target"]) < 1e-5
        assert abs(row["reached"] - row["target"]) < 0.02
    got = mixed.select("row.doc_id", "tokens", "sampled", "copies").toPandas()
    assert (got["sampled"] == (got["copies"] > 0)).all() and got["copies"].max() > 1
    assert abs((got["tokens"] * got["copies"]).sum() / got["tokens"].sum() - 0.8) < 0.02
    taken = mixing.sample(docs, "times", targets=targets, share=0.8).select("doc_id", "times").collect()
    assert {r["doc_id"]: r["times"] for r in taken} == {r.doc_id: r.copies for r in got.itertuples() if r.copies}
    once = mixing.sample(docs, targets=targets, share=0.8)
    assert once.columns == docs.columns and once.groupBy("doc_id").count().where("count > 1").count() == 0


def test_odd_rows(spark):
    docs = odd(spark)
    got = mixing.mix(docs).select("row.doc_id", "source", "lang", "tokens", "probability", "sampled").collect()
    assert len(got) == len(ODD)
    assert all(r["probability"] == 0 and not r["sampled"] for r in got if r["tokens"] == 0)
    assert {r["source"] for r in got if r["doc_id"] == 3} == {mixing.NONE}
    assert len({r["sampled"] for r in got if r["doc_id"] == 2}) == 1
    assert mixing.sample(docs).columns == docs.columns


def test_empty_table(spark):
    assert mixing.mix(empty(spark)).count() == 0
    nothing = table(spark, [(1, None, "en", "a", 0), (2, "", "en", "a", 0)])
    assert mixing.sample(nothing).count() == 0
