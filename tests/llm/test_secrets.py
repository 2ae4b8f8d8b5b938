from turnframe.llm.secrets import KINDS, secret_spans

SECRET = "aB3xK9zQ7mP2wR5tY8uL1vN4cD6eF0gHjJkSsTtUu"


def test_a_span_partly_in_a_named_one_stays(spark):
    texts = [f"see AKIA{'Z9' * 8}/{SECRET} there", f"see {SECRET[:20]}{'0a1b2c3d' * 3}{SECRET[20:]} there", f"token={SECRET}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secret_spans(rows).collect()}
    for i in (0, 1):
        more = [s for s in spans[i] if s.kind >= len(KINDS)]
        assert [s.name for s in spans[i] if s.kind < len(KINDS)] == ["access" if i == 0 else "hex"] and len(more) == 1
        assert more[0].end == len(texts[i]) - len(" there")
    assert [s.name for s in spans[2]] == ["assign"]
