"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from conftest_data import DOCS, edge_docs
from textlab.llm.exact import exact_duplicates
from textlab.llm.licences import licence_labels
from textlab.llm.lines import drop_lines
from textlab.llm.lm import lm_scores
from textlab.llm.mixing import mix_report, mix_rows
from textlab.llm.neardup import keep_one, near_duplicates
from textlab.llm.packing import pack
from textlab.llm.quality import keep_good, quality_rules
from textlab.llm.secrets import secret_spans
from textlab.llm.warc import archive_folder, read_archives, write_archives


@pytest.fixture(scope="module")
def docs(spark):
    return edge_docs(spark).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (3, None), (None, 1), (99, 0)], "doc_id bigint, quality int")


PER_ROW = [secret_spans, licence_labels, lm_scores, exact_duplicates, mix_report, near_duplicates]


@pytest.mark.parametrize("operator", PER_ROW, ids=lambda f: f.__name__)
def test_one_row_per_row(docs, operator):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in operator(docs).collect())
    assert got == sorted((d[0] is None, d[0] or 0) for d in DOCS)


@pytest.mark.parametrize("operator", [*PER_ROW, pack], ids=lambda f: f.__name__)
def test_empty_table(docs, operator):
    assert operator(docs.limit(0)).collect() == []


@pytest.mark.parametrize("operator", [drop_lines, keep_one, mix_rows], ids=lambda f: f.__name__)
def test_rows_keep_their_columns(docs, operator):
    out = operator(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert out.count() > 0 and operator(docs.limit(0)).count() == 0


def test_quality_without_a_model(docs, labels):
    rows = quality_rules(docs, labels).collect()
    assert len(rows) == len(DOCS) and all(r["probability"] is None and r["kept"] == (not r["base_failed"]) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["n_words"] == by[5]["n_words"] == 0 and not by[4]["kept"]
    assert by[9]["n_words"] == 240_000 == by[9]["n_repeat_words"] and by[9]["base_failed"]
    assert by[10]["n_dup_lines"] == 1
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None, 1, 2, 3, 10}
    assert quality_rules(docs.limit(0), labels).count() == 0


def test_exact(docs):
    by = {(r["doc_id"], r["keep_id"]): r for r in exact_duplicates(docs).collect()}
    assert by[1, 2]["group_size"] == 3 and not by[1, 2]["kept"] and by[2, 2]["kept"]
    assert by[4, 5]["group_size"] == 3 and by[5, 5]["kept"]  # nulls and the empty text
    assert by[10, 10]["group_size"] == 2 and by[10, 10]["kept"]
    assert by[None, 2]["kept"] is False


def test_exact_shuffled_keys_equal_broadcast_keys(docs):
    a, b = exact_duplicates(docs), exact_duplicates(docs, broadcast_keys=0)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_near(docs):
    by = {}
    for r in near_duplicates(docs, words=3, share=(80, 100)).collect():
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"], r["kept"]))
    assert {c for i in (1, 2, 3) for _, c, _ in by[i]} == {1}
    assert by[4] == {(0, 4, True)} and by[6] == {(0, 6, True)}
    assert by[7] == {(1, 7, True)} and by[8] == {(1, 7, False)}  # case folds
    assert all(c is None and k for _, c, k in by[None])
    assert {c for _, c, _ in by[12]} == {12}


def test_lines(docs):
    rows = drop_lines(docs.select("doc_id", "text"), counts=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_dropped"] == 0 and by[1][0]["text"] == DOCS[0][1]
    assert by[2][0]["n_dropped"] == 1 and by[2][0]["text"] == ""
    assert by[3][0]["n_dropped"] == 1  # the fuzzy copy
    assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in by[10]] == [(4, 1, "x\ny\nx")] * 2
    assert by[4][0]["text"] is None and by[5][0]["text"] == "" and by[6][0]["text"] == "   \n\t "


def test_lm_counts(docs):
    by = {r["doc_id"]: r for r in lm_scores(docs).collect()}
    assert by[4]["n_tokens"] == by[5]["n_tokens"] == 1 and by[9]["n_tokens"] == 240_001


def test_pack_edges(docs):
    rows = pack(docs).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert [(r["length"], r["ids"]) for r in rows if r["doc_id"] == 4] == [(1, [0])]


def test_warc_edges(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/é b\n", "<p>x</p>", 1), (2, None, "<p>x</p>", 1), (2, None, "<p>x</p>", 1), (3, "u", None, 1),
         (4, "u", "", 1), (None, "u", "", 1), (None, "v", "only", 1), (5, "u", "é" * 300_000, 1)],
        "page_id bigint, url string, html string, keep int")
    folder = archive_folder(spark)
    got = read_archives(write_archives(pages, folder), folder).collect()
    assert sorted(map(str, ((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got))) == sorted(map(str, [
        (1, "revisit", 2, 8), (2, "response", None, 8), (2, "response", None, 8), (3, "revisit", 4, 0), (4, "response", None, 0),
        (None, "revisit", 4, 0), (None, "response", None, 4), (5, "response", None, 600_000)]))
    folder = archive_folder(spark)
    assert read_archives(write_archives(pages.limit(0), folder), folder).count() == 0


def test_pipeline_on_edge_rows_and_an_empty_table(spark, docs, labels, tmp_path):
    """Null ids, texts and sources, repeated rows, long texts and clashing columns through all stages."""
    import corpus_pipeline as P
    for name, table in (("rows", docs), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    rows = P.run(spark, str(tmp_path / "rows")).collect()
    # 2 and 3 are near copies of 1 and lose its line; the null id's only line goes too; 10 stands twice
    assert {r["doc_id"] for r in rows} >= {1, 10} and {r["doc_id"] for r in rows} <= {None, 1, 2, 3, 10}
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(len(r["ids"]) == r["length"] for r in rows)
    by = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert by[1] > 30
    assert P.run(spark, str(tmp_path / "none")).collect() == []
