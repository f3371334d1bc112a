"""Rules for the parts of exam items as Column expressions: numbers, options, answers, types and signs of damage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import broken_commands, strip

# Words that name a question type, in the order in which they are looked for.
TYPE_WORDS = {
    "单选": "single_choice", "多选": "multiple_choice", "多项": "multiple_choice", "不定项": "multiple_choice", "选择": "single_choice",
    "填空": "blank", "判断": "judge", "简答": "essay", "计算": "calc", "思考": "thinking",
}
SECTION_WORDS = {
    "单选": "single_choice", "选择": "single_choice", "多选": "multiple_choice", "填空": "blank", "判断": "judge", "简答": "essay",
    "计算": "calc", "解答": "calc", "思考": "thinking",
}
# Forms of stems, and words of calculation and of open questions.
JUDGE_STEMS = (
    "^判断.*?(是否|对错|正确|错误)", "^判别.*?(是否|正确|错误)", "(是否|对不对).{0,12}(正确|对)", "下列说法(正确|对)(的)?是",
    "下列(说法|描述|命题)(正确|对|错误)(的)?是",
)
CALC_WORDS = ("计算", "试求", "求解", "求值", "算出", "推导", "判别", "画出", "证明", "化简", "展开", "积分", "微分", "解得", "解出")
ESSAY_WORDS = (
    "简述", "论述", "说明", "什么是", "为什么", "名词解释", "谈谈", "分析", "比较", "讨论", "评价", "解释", "阐述", "总结", "列举",
    "举例说明", "描述",
)
PREAMBLE_WORDS = (
    "试卷", "满分", "考试时间", "姓名", "学号", "班级", "考场", "座位", "准考证", "监考", "注意事项", "答题卡", "密封线", "得分", "评卷",
    "命题", "审题", "复核", "学年", "学期", "专业", "院系", "年级", "科目", "课程", "题号", "座位号", "考生号",
)
# What may stand in the lines of an exam paper.
NUMERALS = "一二三四五六七八九十"
PAIR_NUMBER = r"【\s*\d{1,3}\s*[-－—]\s*\d{1,3}\s*】"
ITEM_START = rf"(?U)^\s*(?:第\s*\d+\s*题|问\s*\d{{0,3}}\s*[:：]|{PAIR_NUMBER}|\d{{1,3}}\s*[.．、)）：:])"
SECTION_LINE = rf"(?U)^[{NUMERALS}]+、\s*[（(]?\s*({'|'.join(SECTION_WORDS)})题?"
NUMBERED_HEAD = rf"(?U)^\s*[{NUMERALS}]+\s*[、.．]\s*\S"
TOPIC_LINE = r"(?Us)^\s*知识点\s*[:：]\s*(.*)$"
SUB_ITEM = r"(?U)^\s*[（(]\s*\d{1,3}\s*[）)]"
OPTION_LINE = r"(?Us)^\s*[（(]?\s*([A-Ha-h])\s*(?:[.．、)）]\s*|\s+)(.*)$"
OPTION_MARK = r"(?U)(?<![A-Za-z0-9])[A-Ha-h]\s*[.．、)）]"
OPTION_PREFIX = r"(?U)^[（(]?[A-Ha-h]\s*(?:[.．、)）]\s*|\s+)"
ANSWER_LINE = r"(?Us)^\s*(?:\[?【?)?\s*(?:答案|参考答案)\s*[】\]）)】]?\s*[:：]?\s*(.*)$"
ANSWER_VALUE = r"[A-Ha-h]{1,8}|\d+/\d+|√\d+|[-+]?\d+(?:\.\d+)?"
TYPE_MARK = r"(?U)^【\s*([^】]{0,16}?题?)\s*】"
JUDGE_OPTIONS = r"(?U)^(对|错|正确|错误)([\s、，,]+(对|错|正确|错误))*$"
PAGE_HEADER = r"(?U)^\s*第\s*\d+\s*页\s*/\s*共\s*\d+\s*页\s*$"
SEPARATOR_LINE = "^[-=—]{5,}$"
MATH_SYMBOL = "[\\u222b\\u2211\\u221a\\u2202\\u221e\\u2190-\\u21ff\\u03b1-\\u03c9\\u2208\\u2209\\u2260\\u2264\\u2265\\u00d7\\u00f7\\u00b1]"
GAP = r"(?U)(?:为|是|等于|均为|相距|间距|大于|小于|宽度|长度|半径|质量)\s*[，。、；]"
BRACKETS = r"（）()\[\]【】"


def type_of_words(c: Column, words: dict[str, str] = TYPE_WORDS) -> Column:
    """The type that the first word of the list found in c names; null if none is."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(w)), F.lit(t)) for w, t in words.items()])


def without_formulas(c: Column) -> Column:
    return F.regexp_replace(c, r"\$[^$\n]+\$", "")


def has_blank_mark(stem: Column) -> Column:
    """A line or empty brackets to fill in, outside formulas."""
    return F.regexp_replace(without_formulas(stem), r"\\\(.*?\\\)", "").rlike(r"(?U)_+|＿+|（\s*）|\(\s*\)")


def detect_qtype(type_text: Column, n_options: Column, stem: Column, section: Column) -> Column:
    """By the type line, the mark before the stem, options, the section, and last by the stem's own form; blank otherwise."""
    contains_any = lambda words: stem.rlike("|".join(words))
    return (
        F.when(type_of_words(type_text).isNotNull(), type_of_words(type_text))
        .when(type_of_words(F.regexp_extract(stem, TYPE_MARK, 1)).isNotNull(), type_of_words(F.regexp_extract(stem, TYPE_MARK, 1)))
        .when(n_options >= 2, F.when(section == "multiple_choice", section).otherwise("single_choice"))
        .when(section.isNotNull(), section)
        .when(contains_any(JUDGE_STEMS), "judge")
        .when(has_blank_mark(stem) | stem.rlike(r"(?U)=\s*$"), "blank")
        .when(stem.startswith("求") | contains_any(CALC_WORDS) | stem.rlike("[，。；]求"), "calc")
        .when(stem.rlike(f"^(?:{'|'.join(ESSAY_WORDS)})"), "essay")
        .otherwise("blank")
    )


def clean_answer(raw: Column, qtype: Column) -> Column:
    """An answer as its type has it: sorted letters and digits, one letter, 对 or 错, or the text without one pair of brackets."""
    a = strip(F.coalesce(raw, F.lit("")))
    bare = F.regexp_replace(a, f"^[{BRACKETS}]+|[{BRACKETS}]+$", "")
    signs = F.split(F.upper(F.regexp_replace(a, "[^A-Za-z0-9]", "")), "")
    many = F.array_join(F.array_sort(F.array_distinct(F.filter(signs, lambda x: x != ""))), "")
    word = F.when(F.contains(bare, F.lit(" ")), F.regexp_extract(bare, r"(?U)(\S+)", 1)).otherwise(bare)
    judged = F.when(word.rlike("^(对|正确|√$|是$|T$|TRUE$)"), "对").when(word.rlike("^(错|×$|否$|X$|F$|FALSE$)"), "错").otherwise(word)
    wrapped = a.rlike(r"(?s)^（.*）$|^\(.*\)$")
    return (
        F.when(qtype == "multiple_choice", many).when(qtype == "single_choice", F.when(bare.rlike("^[A-Za-z]"), F.upper(F.substring(bare, 1, 1))).otherwise(bare))
        .when(qtype == "judge", judged).otherwise(F.when(wrapped, F.regexp_replace(a, r"(?s)^.(.*).$", "$1")).otherwise(a))
    )


def split_options(line: Column) -> Column:
    """The options that stand side by side on one line; null if it holds fewer than two, or more than brackets before them."""
    parts = F.split(line, OPTION_MARK)
    texts = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: strip(F.regexp_replace(strip(x), "[（(]+$", "")))
    fits = (F.size(parts) > 2) & parts[0].rlike(r"^[（( \t]*$") & F.exists(texts, lambda x: x != "")
    return F.when(fits, texts)


_KEY_ENTRY = rf"(\d{{1,3}})\s*[.．、]?\s*({ANSWER_VALUE})"


def answer_key(line: Column) -> Column:
    """Entries (number, value) of a line."""
    numbers, values = (F.regexp_extract_all(line, F.lit(f"(?U){_KEY_ENTRY}"), F.lit(g)) for g in (1, 2))
    return F.transform(F.arrays_zip(numbers.alias("n"), values.alias("v")), lambda x: F.struct(x["n"].cast("int").alias("qnum"), F.upper(x["v"]).alias("value")))


def is_answer_key(line: Column) -> Column:
    """Nothing but numbers with answers, after the word for answer or with a letter among them.

    Entries are taken from left to right, each as long as it can be; a line is not divided in any other way, so that lines of any
    length take linear time.
    """
    others, digit = line.rlike(r"(?U)[^答案参考:：\s\dA-Ha-h.．、,，;；/√+\-]"), line.rlike(r"(?U)\d")
    head = r"(?U)^\s*(?:答案|参考答案)?\s*[:：]?\s*"
    rest = F.regexp_replace(F.regexp_replace(line, head, ""), rf"(?U){_KEY_ENTRY}\s*[,，;；、]?\s*", "")
    lettered = F.exists(answer_key(line), lambda x: x["value"].rlike("^[A-H]{1,8}$"))
    # Cheap tests first: few lines are made of these signs alone.
    return F.when(others | ~digit, False).otherwise((rest == "") & (line.rlike(r"(?U)^\s*(?:答案|参考答案)") | lettered))


def item_number(line: Column) -> Column:
    """The number at the head of an item; null where there is none."""
    return F.regexp_extract(F.regexp_extract(line, ITEM_START, 0), r"(?U)(\d+)", 1).try_cast("int")


def needs_review(question: Column, answer: Column, options: Column, explanation: Column, formula: Column | None = None) -> Column:
    """A placeholder tag, a broken command, or two signs that a formula was lost."""
    stem = F.coalesce(question, F.lit(""))
    texts = [F.nullif(x, F.lit("")) for x in (stem, *([formula] if formula is not None else []), answer, explanation)]
    all_of_it = F.concat_ws(" ", *texts, options)
    plain = without_formulas(stem)
    lone = plain.rlike(MATH_SYMBOL)
    signs = (
        (F.regexp_count(stem, F.lit(r"\$")) % 2 == 1), stem.rlike(r"(?U)[（(]\s*[）)]") & (lone | plain.rlike("[A-Za-z0-9]")), lone,
        (F.length(stem) < 15) & stem.rlike("[=∫∑√（(]"), (strip(F.coalesce(answer, F.lit(""))) == "") & lone,
    )
    score = sum((s.cast("int") for s in signs), F.least(F.regexp_count(stem, F.lit(GAP)), F.lit(2)))
    return all_of_it.rlike("(?i)<(?:Formula|ImgRef)[^>]*>") | (broken_commands(all_of_it) > 0) | (score >= 2)


def is_preamble(block: Column) -> Column:
    """The head of a paper rather than an item: one of its words, or a year first."""
    return block.rlike("|".join(PREAMBLE_WORDS)) | block.rlike(r"(?U)^\s*\d{4}\s*年")
