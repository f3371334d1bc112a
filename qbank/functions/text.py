"""Text rules as Column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qbank.schemas import ANSWER_PLACEHOLDER, LEGACY_QTYPES, QTYPE_LABELS, QTYPES

# The private-use code points of a word processor's math font and what they stand for.
PRIVATE_USE = {
    0xF02D: "−", 0xF03D: "=", 0xF02B: "+", 0xF02A: "*", 0xF039: ",", 0xF03A: ";", 0xF03B: ":", 0xF03C: "<", 0xF03E: ">",
    0xF035: "≤", 0xF036: "≥", 0xF038: "≠",
    0xF061: "α", 0xF062: "β", 0xF067: "γ", 0xF064: "δ", 0xF065: "ε", 0xF071: "θ", 0xF06C: "λ", 0xF06D: "μ", 0xF06E: "ν",
    0xF070: "π", 0xF072: "ρ", 0xF073: "σ", 0xF074: "τ", 0xF076: "φ", 0xF078: "ψ", 0xF079: "ω", 0xF077: "ω",
    0xF041: "Α", 0xF042: "Β", 0xF043: "Γ", 0xF044: "Δ", 0xF045: "Ε", 0xF046: "Ζ", 0xF047: "Η", 0xF048: "Θ", 0xF049: "Ι",
    0xF04A: "Κ", 0xF04B: "Λ", 0xF04C: "Μ", 0xF04D: "Ν", 0xF04E: "Ξ", 0xF04F: "Ο", 0xF050: "Π", 0xF051: "Ρ", 0xF052: "Σ",
    0xF053: "Τ", 0xF054: "Υ", 0xF055: "Φ", 0xF056: "Χ", 0xF057: "Ψ", 0xF058: "Ω",
    0xF028: "(", 0xF029: ")", 0xF0A2: "′", 0xF0A5: "∞", 0xF0AB: "↔", 0xF0D7: "·", 0xF0F2: "∫",
    0xF0E6: "(", 0xF0F6: ")", 0xF0E7: "(", 0xF0F7: ")", 0xF0E8: "(", 0xF0F8: ")", 0xF0E9: "[", 0xF0F9: "]",
    0xF0EA: "(", 0xF0FA: ")", 0xF0EB: "[", 0xF0FB: "]", 0xF0EC: "{", 0xF0ED: "{", 0xF0EE: "0", 0xF0EF: " ",
}
# Latin-1 letters that the same font uses for symbols; replaced only where a text is known to come from it.
LATIN1_SYMBOLS = {"ò": "∫", "õ": "∐", "ö": "∑", "¥": "∞", "¹": "√", "º": "∝", "ù": "←", "ú": "→", "û": "↑", "ü": "↓", "ý": "↔", "þ": "⇐", "ÿ": "⇒"}
# Commands that count as known, in lower case where only that matters.
KNOWN_COMMANDS = (
    "sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "exp", "lim", "gcd", "arg", "frac", "sqrt", "sum", "int", "iint", "iiint",
    "oint", "prod", "infty", "partial", "nabla", "to", "rightarrow", "leftarrow", "leftrightarrow", "Rightarrow", "Leftarrow", "cdot",
    "cdots", "ldots", "times", "div", "pm", "mp", "neq", "leq", "geq", "approx", "equiv", "in", "notin", "subset", "supset", "subseteq",
    "supseteq", "cup", "cap", "forall", "exists", "text", "quad", "qquad", "begin", "end", "left", "right", "big", "bigg", "bigl", "bigr",
    "alpha", "beta", "gamma", "delta", "epsilon", "varepsilon", "zeta", "eta", "theta", "vartheta", "iota", "kappa", "lambda", "mu", "nu",
    "xi", "pi", "rho", "sigma", "tau", "upsilon", "phi", "varphi", "chi", "psi", "omega", "Gamma", "Delta", "Theta", "Lambda", "Xi", "Pi",
    "Sigma", "Upsilon", "Phi", "Psi", "Omega",
)
# Named entities: first those that are common, as a lookup goes through a map from its beginning; all others by their first letter.
COMMON_ENTITIES = {f"{n};": html5[f"{n};"] for n in "amp lt gt quot nbsp copy middot hellip mdash ndash ldquo rdquo lsquo rsquo times deg".split()}
# Names that stand for a character without a semicolon too, the longest first.
SHORT_ENTITIES = {n: html5[n] for n in sorted(html5, key=lambda n: (-len(n), n)) if not n.endswith(";")}
# What a number from 128 to 159 stands for: that byte of Windows-1252, or itself where that has none.
WINDOWS = {n: bytes([n]).decode("cp1252") if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(n) for n in range(0x80, 0xA0)}

ANCHOR = "【图:([^】]+)】"


def _lookup(values: dict[str, str]) -> Column:
    """A map out of two strings, which Catalyst folds into one literal."""
    listed = lambda x: F.split(F.lit("\u0001".join(x)), "\u0001")
    return F.map_from_arrays(listed(values), listed(values.values()))


def strip(c: Column) -> Column:
    """Without white space at the ends, as Unicode defines it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_qtype(c: Column) -> Column:
    """The question type of any spelling; blank for what is unknown or null."""
    return F.coalesce(F.try_element_at(_lookup({**{q: q for q in QTYPES}, **LEGACY_QTYPES}), F.lower(strip(c))), F.lit("blank"))


def qtype_label(c: Column) -> Column:
    """The label of a type, or the value itself."""
    return F.coalesce(F.try_element_at(_lookup(QTYPE_LABELS), c), c)


def has_answer(c: Column) -> Column:
    """Neither blank nor the placeholder."""
    return F.coalesce((strip(c) != "") & ~F.contains(c, F.lit(ANSWER_PLACEHOLDER)), F.lit(False))


def content_hash(question: Column, answer: Column, options: Column | None = None) -> Column:
    """H1: fingerprint of stem, options and answer without anchors, white space, brackets and punctuation."""
    parts = [F.regexp_replace(F.coalesce(question, F.lit("")), ANCHOR, "")]
    parts += [F.coalesce(F.array_join(options, ""), F.lit(""))] if options is not None else []
    return F.md5(F.regexp_replace(F.concat(*parts, F.coalesce(answer, F.lit(""))), r"(?U)[\s\\{}()【】\[\]（）.,，。、;；:：]+", ""))


def basename(c: Column) -> Column:
    """The last part of a path; null if it is blank, a dot or holds two dots in a row."""
    name = F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when((strip(name) != "") & (name != ".") & ~F.contains(name, F.lit("..")), name)


def _entity_by_letter(name: Column) -> Column:
    """The character of a name with a semicolon, looked up among those of its first letter."""
    letters: dict[str, dict[str, str]] = {}
    for n, c in html5.items():
        if n.endswith(";"):
            letters.setdefault(n[0], {})[n] = c
    maps = F.from_json(F.lit(json.dumps(letters, ensure_ascii=False)), "map<string,map<string,string>>")  # folded into one literal
    return F.try_element_at(F.try_element_at(maps, F.substring(name, 1, 1)), name)


def _entity_by_number(x: Column) -> Column:
    """The character of &#n; or &#xn;: bytes of Windows-1252 from 128 to 159, a replacement character for 0, surrogates and what is
    beyond Unicode, nothing for control characters and non-characters."""
    digits = F.regexp_extract(x, "^&#0*([0-9]*)", 1)
    hexes = F.regexp_extract(x, "^&#[xX]0*([0-9A-Fa-f]*)", 1)
    n = F.when(x.rlike("^&#[xX]"), F.when(F.length(hexes) <= 6, F.conv(F.concat(F.lit("0"), hexes), 16, 10).cast("long"))).otherwise(
        F.when(F.length(digits) <= 7, F.concat(F.lit("0"), digits).cast("long"))
    )

    def char(n: Column) -> Column:
        lost = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        windows = F.substring(F.lit("".join(WINDOWS.values())), (n - 0x7F).cast("int"), F.lit(1))
        nothing = n.between(1, 8) | (n == 0xB) | n.between(0xE, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        return F.when(lost, "\ufffd").when(n.between(0x80, 0x9F), windows).when(nothing, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    return let(n, char)


def unescape_once(c: Column) -> Column:
    """One round of entity decoding as HTML has it: names with a semicolon, the old names without one (the longest that the text
    begins with), decimal and hexadecimal numbers with or without a semicolon; all else stays."""
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&)"), F.lit(1))

    def named(x: Column) -> Column:
        name = F.regexp_replace(x, "^&", "")
        short = F.regexp_extract(name, f"^({'|'.join(SHORT_ENTITIES)})", 1)
        begun = F.when(short != "", F.concat(F.try_element_at(_lookup(SHORT_ENTITIES), short), F.substring(name, F.length(short) + 1, F.length(name))))
        whole = F.when(name.endswith(";"), F.coalesce(F.try_element_at(_lookup(COMMON_ENTITIES), name), _entity_by_letter(name)))
        return F.coalesce(whole, begun, x)

    one = lambda x: F.when(~x.rlike("^&."), x).when(x.rlike("^&#"), F.when(x.rlike("^&#([0-9]|[xX][0-9a-fA-F])"), _entity_by_number(x)).otherwise(x)).otherwise(named(x))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(tokens, one), "")).otherwise(c)


def html_unescape(c: Column) -> Column:
    """H2: at most two rounds."""
    return F.when(F.contains(c, F.lit("&")), let(unescape_once(c), unescape_once)).otherwise(c)


def fix_private_use(c: Column, latin1: bool = False) -> Column:
    """H3: private-use characters as the standard ones; Latin-1 letters only on request, as they are letters in most texts."""
    table = {chr(k): v for k, v in PRIVATE_USE.items()} | (LATIN1_SYMBOLS if latin1 else {})
    return F.translate(c, "".join(table), "".join(table.values()))


def rule_clean(c: Column, then: Callable[[Column], Column] | None = None) -> Column:
    """H7: stripped lines without blank ones, page numbers and separators; entities and private-use characters decoded. then is what
    is done at the end on request: latex.unicode_to_latex makes commands of symbols."""
    lines = F.transform(F.split(F.regexp_replace(html_unescape(c), "\r\n?", "\n"), "\n"), strip)
    keep = lambda x: (x != "") & ~x.rlike(r"^第\s*\d+\s*页\s*[/／]\s*共\s*\d+\s*页$") & ~x.rlike(r"^[-=—*_~]{5,}$")
    clean = fix_private_use(F.array_join(F.filter(lines, keep), "\n"))
    return then(clean) if then else clean


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


# Counts are single regular expressions over the whole text; those for lines take the rest of the line along, so each counts once.
LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def token_count(c: Column) -> Column:
    return _count(c, r"(?U)\S+")


def single_char_count(c: Column) -> Column:
    return _count(c, r"(?U)(?<!\S)[^\s\u4e00-\u9fff$](?!\S)")


def single_char_ratio(c: Column) -> Column:
    """H8: share of tokens of one character that is neither a CJK ideograph nor a dollar sign."""
    return F.coalesce(F.try_divide(single_char_count(c), token_count(c)), F.lit(0.0))


def broken_commands(c: Column) -> Column:
    """H9: commands nobody knows that are followed by white space and a letter."""
    known = F.array(*[F.lit(x) for x in sorted({k.lower() for k in KNOWN_COMMANDS})])
    found = F.regexp_extract_all(c, F.lit(r"(?U)\\([a-zA-Z]{2,})\s+[a-zA-Z]"), F.lit(1))
    return F.size(F.filter(found, lambda x: ~F.array_contains(known, F.lower(x)))).cast("long")


def private_use_count(c: Column) -> Column:
    """Characters of the private-use area from U+F000 on."""
    return _count(c, r"[\uf000-\uf8ff]")


def line_count(c: Column) -> Column:
    """Lines that are not blank."""
    return _count(c, rf"(?U)[^\s{LINE_ENDS}][^{LINE_ENDS}]*")


def cjk_line_count(c: Column) -> Column:
    """Lines with four CJK ideographs in a row."""
    return _count(c, rf"[\u4e00-\u9fff]{{4}}[^{LINE_ENDS}]*")


def cjk_line_ratio(c: Column) -> Column:
    """Share of lines that are not blank with four CJK ideographs in a row."""
    return F.coalesce(F.try_divide(cjk_line_count(c), line_count(c)), F.lit(0.0))


def quality_profile(c: Column) -> Column:
    """Struct of the counts that the score is made of."""
    return F.struct(
        token_count(c).alias("n_tokens"), single_char_count(c).alias("n_single"), broken_commands(c).alias("n_broken"),
        private_use_count(c).alias("n_private"), line_count(c).alias("n_lines"), cjk_line_count(c).alias("n_cjk_lines"),
    )


def quality_score(c: Column, threshold: float = 0.30) -> Column:
    """Struct of score, fragmented and the number of reasons; a blank text scores 1. Each count is made once."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def judge(m: Column) -> Column:
        rules = (
            (share(m["n_single"], m["n_tokens"]) > 0.30, 45), (m["n_broken"] >= 2, 35), (m["n_private"] >= 1, 30),
            ((m["n_lines"] > 5) & (share(m["n_cjk_lines"], m["n_lines"]) < 0.25), 25),
        )
        points = F.least(sum((F.when(hit, n).otherwise(0) for hit, n in rules), F.lit(0)), F.lit(100))
        reasons = sum((hit.cast("long") for hit, _ in rules), F.lit(0).cast("long"))
        blank = m["n_tokens"] == 0
        score = F.when(blank, 1.0).otherwise(points / F.lit(100.0))
        return F.struct(score.alias("score"), (score >= threshold).alias("fragmented"), F.when(blank, F.lit(1).cast("long")).otherwise(reasons).alias("n_reasons"))

    return let(let(strip(F.coalesce(c, F.lit(""))), quality_profile), judge)


def choose_text(rows: DataFrame, text: str, other: str) -> DataFrame:
    """Rows with outcome and chosen: a fragmented or blank text is replaced by one that is not blank and scores less, else rejected."""
    mine, theirs = F.col("_mine"), F.col("_theirs")
    better = (strip(F.coalesce(other, F.lit(""))) != "") & (theirs["score"] < mine["score"])
    # The other text is only judged where that matters.
    out = rows.withColumn("_mine", quality_score(F.col(text))).withColumn("_theirs", quality_score(F.when(mine["fragmented"], F.col(other))))
    out = out.withColumn("outcome", F.when(~mine["fragmented"], "kept").when(better, "replaced").otherwise("rejected"))
    chosen = F.when(F.col("outcome") == "kept", F.col(text)).when(F.col("outcome") == "replaced", F.col(other))
    return out.withColumn("chosen", chosen).drop("_mine", "_theirs")


def anchors(c: Column) -> Column:
    """Names in image anchors, in order."""
    return F.regexp_extract_all(c, F.lit(ANCHOR), F.lit(1))


def latex_ok(c: Column) -> Column:
    """Balanced braces by count, no dollar sign, no begin, and no unknown command glued to a letter."""
    known = F.array(*[F.lit(x) for x in KNOWN_COMMANDS])
    # A command takes all ASCII letters, so what follows it as a letter is one beyond ASCII.
    glued = F.regexp_extract_all(c, F.lit(r"(?U)\\([a-zA-Z]++)(?=[^\W\d_])"), F.lit(1))
    ok = (F.regexp_count(c, F.lit(r"\{")) == F.regexp_count(c, F.lit(r"\}"))) & ~F.contains(c, F.lit("$")) & ~F.contains(c, F.lit(r"\begin{"))
    return F.coalesce((strip(c) != "") & ok & ~F.exists(glued, lambda x: ~F.array_contains(known, x)), F.lit(False))
