from qbank.functions import text


def test_other_text_is_judged_only_for_fragments(spark, monkeypatch):
    judged, score = [], text.quality_score
    monkeypatch.setattr(text, "quality_score", lambda c, *more: (judged.append(str(c)), score(c, *more))[1])
    rows = spark.createDataFrame([("whole words here", None), ("a b c d e", "whole words"), ("a b c d e", " "), (None, "x y z"), ("", "whole words")], "text string, other string")
    got = [(r["outcome"], r["chosen"]) for r in text.choose_text(rows, "text", "other").collect()]
    assert got == [("kept", "whole words here"), ("replaced", "whole words"), ("rejected", None), ("replaced", "x y z"), ("replaced", "whole words")]
    assert "fragmented" in judged[1]
