"""Fixed values and schemas of a question bank."""

# Question types in order, their labels, and spellings of older banks.
QTYPES = ("single_choice", "multiple_choice", "blank", "judge", "essay", "calc", "thinking")
QTYPE_LABELS = dict(zip(QTYPES, ("单选题", "多选题", "填空题", "判断题", "简答题", "计算题", "思考题"), strict=True))
LEGACY_QTYPES = {"single": "single_choice", "multi": "multiple_choice", "multiple": "multiple_choice"}
ANSWER_PLACEHOLDER = "（待补充答案）"
