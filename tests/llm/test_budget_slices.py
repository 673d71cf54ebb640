import pytest

from vellum.llm.budget_queries import p5_found, p5_tokens


@pytest.fixture()
def folder(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    write("legal_source", [(1, "north-code", "code"), (2, "south-act", "law")], "source_id int, source_key string, authority string")
    write("document_version", [(10, 1, " EN_xx"), (20, 2, "fr"), (30, None, "de"), (30, None, "de")], "document_version_id long, source_id int, lang string")
    write("structural_unit", [(1, 10, "the price list"), (1, 10, "the price list"), (2, 20, None), (3, 20, ""), (4, 30, "text"), (5, 10, "never hit")], "unit_id long, document_version_id long, text string")
    hits = [
        (1, "North Code", "CODE "),
        (1, "NORTH_CODE ", None),
        (1, None, "n/a"),
        (2, " ", "Guidance"),
        (3, "unheard of", ""),
        (4, None, None),
        (99, "north-code", "law"),
        (None, "north-code", "law"),
    ]
    write("candidate", hits * 3, "structural_unit_id long, source_key string, authority string")
    return str(tmp_path)


def test_true_names(spark, folder):
    found = {tuple(r) for r in p5_found(spark, folder).collect()}
    assert found == {("north-code", "en", "code"), ("south-act", "fr", "guidance"), ("south-act", "fr", "law"), (None, "de", None)}


def test_each_unit_once(spark, folder):
    rows = {(r["source_key"], r["authority"]): (r["units"], r["n_chars"]) for r in p5_tokens(spark, folder).collect()}
    assert rows == {("north-code", "code"): (1, 14), ("south-act", "guidance"): (1, 0), ("south-act", "law"): (1, 0), (None, None): (1, 4)}
    assert {r["tokens"] for r in p5_tokens(spark, folder).where("n_chars = 0").collect()} == {0}
