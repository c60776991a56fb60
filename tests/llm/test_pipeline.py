import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tarnlake.llm.common import clean, settle, shared_dir, table
from tests.llm import oracles
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """sf0.001 with null, empty and repeated rows."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (90001, "", "en", "s", 0), (90002, None, "en", "s", None)], docs.schema)
    docs.unionByName(docs.where("doc_id < 5")).unionByName(odd).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        os.symlink(f"{SF}/{name}.parquet", f"{path}/{name}.parquet")
    return path


def test_each_stage_against_brute_force(spark, planted):
    docs = table(spark, planted, "documents")
    for name, stage in cp.STAGES:
        out = settle(stage(spark, docs, planted), name)
        before, after = docs.collect(), out.collect()
        if name != "packing":
            assert out.columns == COLUMNS
        kept = sorted(str(r["doc_id"]) for r in after)
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in table(spark, planted, "labels").collect()}
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            assert gone and sum(labels.get(d, 1) for d in gone) >= 0.9 * len(gone)
        elif name == "near_duplicates":
            want = groups([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None], 80, 5)
            assert kept == sorted([str(d) for d, (_, c) in want.items() if d == c] + ["None"] * 2)
        elif name == "decontamination":
            items = [tuple(r) for r in table(spark, planted, "benchmark").select("item_id", "text").collect()]
            bad = {d for d, _ in leaks([(r["doc_id"], r["text"]) for r in before], items)}
            assert kept == sorted(str(r["doc_id"]) for r in before if r["doc_id"] not in bad)
        elif name == "pii":
            assert len(after) == len(before)
            assert all(oracles.base_spans(r["text"])[1] == "" for r in after)
            assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in after)
        else:
            check_packing(docs, out)
        docs = out


def test_near_duplicates_choose_rows(spark):
    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcde")
    rows = [(1, a), (1, b), (2, a), (None, b), (None, c), (None, c.upper()), (3, e), (5, e + " end"), (5, d), (5, d), (6, d), (7, " "), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = [(r["doc_id"], r["text"]) for r in cp.drop_near_duplicates(spark, docs, SF).collect()]
    assert sum(x in out for x in [(None, c), (None, c.upper())]) == 1
    want = [(1, a), (1, b), (3, e), (5, d), (7, " "), (None, ""), (None, "")]
    assert sorted(map(str, [x for x in out if (x[1] or "").lower() != c])) == sorted(map(str, want)) and len(out) == 8


def test_run_and_empty_tables(spark, tmp_path):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_pass_through(spark):
    clash = {c: F.lit(c) for c in ("score", "spans", "n", "h", "token", "k", "uid", "item", "component_id")}
    docs = table(spark, SF, "documents").withColumns(clash)
    for name, stage in cp.STAGES[:-1]:
        docs = settle(stage(spark, docs, SF), name)
        assert docs.columns == [*COLUMNS, *clash]
    assert docs.where("score <> 'score' or spans <> 'spans' or token <> 'token'").count() == 0 and docs.count() > 50
    assert stage is cp.mask_personal_data and cp.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_helper_names_leave_columns_alone(spark):
    names = ["_t", "_k", "_key", "_rows", "_n", "_toxicity", "_m0", "_w", "_pii_spans", "__key"]
    docs = table(spark, SF, "documents").withColumns({c: F.lit(c) for c in names})
    for name, stage in cp.STAGES[:-1]:
        docs = settle(stage(spark, docs, SF), name)
        assert docs.columns == [*COLUMNS, *names]
    assert docs.count() > 50 and docs.where(" or ".join(f"{c} is null or {c} <> '{c}'" for c in names)).count() == 0


def test_run_leaves_only_its_result(spark):
    clean(spark)
    out = cp.run(spark, SF)
    top = f"{shared_dir(spark)}/tarnlake-{spark.sparkContext.applicationId}"
    assert len(os.listdir(top)) == 1 and out.count() > 0
