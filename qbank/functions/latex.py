"""Formulas in text as Column expressions: symbols to commands, and which stretches of a text are formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .items import PAIR_NUMBER
from .text import _lookup, fix_private_use, html_unescape, let, strip

# Symbols and what stands for them in a formula.
SYMBOL_COMMANDS = {
    "∫": "\\int", "∮": "\\oint", "∯": "\\iiint", "∬": "\\iint", "∭": "\\idotsint", "∑": "\\sum", "∏": "\\prod", "∞": "\\infty",
    "∂": "\\partial", "∇": "\\nabla", "√": "\\sqrt", "≠": "\\neq", "≈": "\\approx", "≡": "\\equiv", "≤": "\\leq", "≥": "\\geq", "∈": "\\in",
    "∉": "\\notin", "⊂": "\\subset", "⊃": "\\supset", "∪": "\\cup", "∩": "\\cap", "∀": "\\forall", "∃": "\\exists", "→": "\\rightarrow",
    "←": "\\leftarrow", "⇒": "\\Rightarrow", "⇐": "\\Leftarrow", "↔": "\\leftrightarrow", "·": "\\cdot", "×": "\\times", "÷": "\\div",
    "±": "\\pm", "∓": "\\mp", "⊕": "\\oplus", "⊗": "\\otimes", "α": "\\alpha ", "β": "\\beta ", "γ": "\\gamma ", "δ": "\\delta ",
    "ε": "\\epsilon ", "ζ": "\\zeta ", "η": "\\eta ", "θ": "\\theta ", "ι": "\\iota ", "κ": "\\kappa ", "λ": "\\lambda ", "μ": "\\mu ",
    "ν": "\\nu ", "ξ": "\\xi ", "π": "\\pi ", "ρ": "\\rho ", "σ": "\\sigma ", "τ": "\\tau ", "υ": "\\upsilon ", "φ": "\\phi ",
    "χ": "\\chi ", "ψ": "\\psi ", "ω": "\\omega ", "Γ": "\\Gamma ", "Δ": "\\Delta ", "Θ": "\\Theta ", "Λ": "\\Lambda ", "Ξ": "\\Xi ",
    "Π": "\\Pi ", "Σ": "\\Sigma ", "Φ": "\\Phi ", "Ψ": "\\Psi ", "Ω": "\\Omega ", "½": "\\frac{1}{2}", "⅓": "\\frac{1}{3}",
    "¼": "\\frac{1}{4}", "¾": "\\frac{3}{4}", "⁰": "^{0}", "¹": "^{1}", "²": "^{2}", "³": "^{3}", "⁴": "^{4}", "⁵": "^{5}", "⁶": "^{6}",
    "⁷": "^{7}", "⁸": "^{8}", "⁹": "^{9}", "₀": "_{0}", "₁": "_{1}", "₂": "_{2}", "₃": "_{3}", "₄": "_{4}", "₅": "_{5}", "₆": "_{6}",
    "₇": "_{7}", "₈": "_{8}", "₉": "_{9}",
}

# A command that ends with a letter is followed by this mark until it is known whether a letter or digit comes next.
_END = "\u0002"
SYMBOLS = {s: c + _END if c[-1].isalpha() else c for s, c in SYMBOL_COMMANDS.items()}
# What is written plainly, and how a formula has it. A name is only taken where it is a word of its own and no command yet.
_WORD = r"(?<![\\a-zA-Z])"
REWRITES = (
    (r"\(([^)]+)\)/\(([^)]+)\)", r"\\frac{$1}{$2}"), (r"(\d+)/(\d+)", r"\\frac{$1}{$2}"), (r"([a-zA-Z])\^(\d+)", r"$1^{$2}"),
    (r"([a-zA-Z])_(\d+)", r"$1_{$2}"), (rf"{_WORD}lim\b\s*\(([^)]*)\)", r"\\lim_{$1}"), (rf"{_WORD}lim\b(?!_)", r"\\lim"),
    (rf"{_WORD}sum\((\w)=([^,]+),\s*([^)]+)\)", r"\\sum_{$1=$2}^{$3}"), (rf"{_WORD}int\(([^)]+)\)", r"\\int_{$1}"),
)


def _convert(c: Column) -> Column:
    symbols = f"[{''.join(SYMBOLS)}]"
    out = F.when(c.rlike(symbols), F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(_lookup(SYMBOLS), x), x)), "")).otherwise(c)
    for pattern, to in REWRITES:
        out = F.regexp_replace(out, pattern, to)
    matrix = lambda x: F.replace(F.replace(x, F.lit("["), F.lit("\\begin{pmatrix}")), F.lit("]"), F.lit("\\end{pmatrix}"))
    both = lambda x: F.contains(x, F.lit("[")) & F.contains(x, F.lit("]")) & ~F.contains(x, F.lit("\\begin"))
    return let(out, lambda x: F.when(both(x), matrix(x)).otherwise(x))


def unicode_to_latex(c: Column) -> Column:
    """H4: symbols as commands, then fractions, scripts, limits, sums, integrals and brackets of matrices."""
    return F.replace(_convert(c), F.lit(_END), F.lit(""))


# What ends a stretch that may be a formula: ideographs and the marks of Chinese text.
_OUTSIDE = "一-鿿，。、；：？！（）()【】《》“”\"'—…·"
_OPERATED = r"[\dA-Za-zα-ω][+\-*/^=<>]|[+\-*/^=<>][\dA-Za-zα-ω]"


def latexize(c: Column) -> Column:
    """H5: stretches that hold symbols or operators as formulas between dollar signs.

    What is a formula already, image anchors and paired item numbers stay as they are. A space goes between a command and a letter
    or digit after it.
    """
    token = rf"\$[^$\n]+\$|【图:[^】]+】|{PAIR_NUMBER}|[^{_OUTSIDE}$]+|[\s\S]"
    tokens = F.regexp_extract_all(c, F.lit(f"({token})"), F.lit(1))

    def convert(x: Column) -> Column:
        inner = strip(x)

        def wrap(latex: Column) -> Column:
            spaced = F.replace(F.regexp_replace(latex, f"{_END}(?=[A-Za-z0-9])", " "), F.lit(_END), F.lit(""))
            formula = F.concat(F.regexp_extract(x, r"(?U)^(\s*)", 1), F.lit("$"), spaced, F.lit("$"), F.regexp_extract(x, r"(?U)(\s*)$", 1))
            return F.when((latex != inner) | inner.rlike(_OPERATED), formula).otherwise(x)

        whole = x.rlike(rf"^(?:\$[^$\n]+\$|【)") | x.rlike(rf"^[{_OUTSIDE}$]$") | (inner == "")
        return F.when(whole, x).otherwise(let(_convert(inner), wrap))

    return F.array_join(F.transform(tokens, convert), "")


def smart_formula(c: Column) -> Column:
    """H6: entities, private-use characters and symbols converted; the whole text as a formula where a command is left in it."""
    return let(unicode_to_latex(fix_private_use(html_unescape(c))), lambda x: F.when(x.rlike(r"[\\∫∑∞αβπ]"), F.concat(F.lit("$"), x, F.lit("$"))).otherwise(x))


def merge_scripts(segments: Column) -> Column:
    """Neighbouring superscripts, or subscripts, of an array of segments as one."""
    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.coalesce(*[
            F.when(last.rlike(p) & s.rlike(p), F.concat(F.lit(f"${m}{{"), F.regexp_extract(last, p, 1), F.regexp_extract(s, p, 1), F.lit("}$")))
            for m, p in (("^", r"^\$\^\{([^{}]*)\}\$$"), ("_", r"^\$_\{([^{}]*)\}\$$"))
        ])
        return F.when(joined.isNotNull(), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(segments, F.array().cast("array<string>"), step)
