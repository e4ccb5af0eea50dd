"""Outputs of pairs are written once, and hits are looked up outside lambdas."""

from pyspark.sql import functions as F
from test_pair_plans import tables  # noqa: F401

from doclint.operators import keywords as kw
from doclint.operators.scoring import params_text
from doclint.plans.analyze import analyze
from doclint.sources import sinks


def test_no_wide_stage_is_written_and_read_again(spark, tables, tmp_path, monkeypatch):  # noqa: F811
    names, cut = [], sinks.StageTables.cut
    monkeypatch.setattr(sinks.StageTables, "cut", lambda self, df, name: names.append(name) or cut(self, df, name))
    sinks.run_analysis(*tables, str(tmp_path))
    assert "documents_scored" in names and not {"results", "keyword_hits"} & set(names)
    lazy = analyze(*tables)
    for name, want in (("scores", lazy.results.drop("findings")), ("findings", lazy.findings()), ("keyword_hits", lazy.keyword_hits)):
        assert sorted(map(str, spark.read.parquet(f"{tmp_path}/{name}").collect())) == sorted(map(str, want.collect()))


def test_keywords_of_a_pair_for_lists_of_any_length(spark):
    made = []
    for i, size in enumerate((0, 1, 5, 32, 33, 70)):
        found, stuffed = [k for k in range(size) if k % 3 != 1], [k for k in range(size) if k % 5 == 2 and k % 3 != 1]
        made.append((i, 9, 100, found[::-1] + [999], [3] * (len(found) + 1), stuffed, [*range(size)], ["skill"] * size, [f"t{k // 2}" for k in range(size)], [1.0] * size, [*range(size, 0, -1)], [k + 1 for k in range(size)], sum(range(1, size + 1))))
    made.append((7, None, 100, [1], [1], [], None, None, None, None, None, None, None))
    rows = spark.createDataFrame(made, "doc_id long, job_id long, words int, term_ids array<long>, term_ns array<int>, term_often array<long>, kw_ids array<long>,"
                                 " kw_kinds array<string>, kw_terms array<string>, kw_weights array<double>, kw_ranks array<int>, kw_millis array<int>, kw_total long")
    got = {r.doc_id: r for r in kw.match_scores(kw.matched(rows)).collect()}
    hits = {}
    for r in kw.hits_of(kw.matched(rows)).collect():
        hits.setdefault(r.doc_id, []).append((r["rank"], r.term, r.n, r.matched, r.stuffed))
    for i, size in enumerate((0, 1, 5, 32, 33, 70)):
        found, stuffed = [k for k in range(size) if k % 3 != 1], [k for k in range(size) if k % 5 == 2 and k % 3 != 1]
        r = got[i]
        assert r.matched == [f"t{k // 2}" for k in found] and r.missing == [f"t{k // 2}" for k in range(size) if k % 3 == 1]
        assert r.hit_milli == sum(k + 1 for k in found if k not in stuffed) and r.n_stuffed == len(stuffed)
        assert hits.get(i, []) == [(size - k, f"t{k // 2}", 3 * (k in found), k in found, k in stuffed) for k in range(size)]
    assert got[7].matched is None and got[7].keyword_score is None and 7 not in hits


def test_hits_are_not_looked_up_inside_a_lambda(tables):  # noqa: F811
    hits = analyze(*tables).keyword_hits._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(kw_found" in hits and "lambdafunction(named_struct(rank" not in hits


def test_parameters_as_text(spark):
    rows = spark.sql("SELECT map('b', '1', 'a', '2') AS p UNION ALL SELECT map('x', '7') UNION ALL SELECT map('x', CAST(NULL AS STRING)) UNION ALL"
                     " SELECT CAST(map() AS map<string,string>) UNION ALL SELECT CAST(NULL AS map<string,string>) UNION ALL SELECT map('b', CAST(NULL AS STRING), 'a', 'c')")
    assert [r[0] for r in rows.select(params_text(F.col("p"))).collect()] == ["a=2;b=1", "x=7", "", "", None, "a=c"]
