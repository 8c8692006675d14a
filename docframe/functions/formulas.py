"""Mathematical lines, and their symbols in LaTeX."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols and their commands.
LATEX = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "θ": "theta", "λ": "lambda", "μ": "mu", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "φ": "phi", "ω": "omega", "Γ": "Gamma", "Δ": "Delta", "Σ": "Sigma", "Φ": "Phi", "Ω": "Omega", "∑": "sum", "∏": "prod", "∫": "int", "√": "sqrt", "∂": "partial", "∇": "nabla", "∞": "infty", "≤": "leq", "≥": "geq", "≠": "neq", "≈": "approx", "±": "pm", "×": "times", "·": "cdot", "÷": "div", "∈": "in", "∉": "notin", "⊂": "subset", "∪": "cup", "∩": "cap", "→": "to", "⇒": "Rightarrow", "∀": "forall", "∃": "exists"}
MATH = "".join(LATEX) + "=+<>−∓⊗⊕∼∝"


def math_signs(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, MATH, ""))


def is_formula(text: Column, math_font: Column | None = None) -> Column:
    """At least two mathematical signs, or one in a mathematical font."""
    signs = math_signs(text)
    return (signs >= 2) | ((signs >= 1) & math_font) if math_font is not None else signs >= 2


def to_latex(text: Column) -> Column:
    return F.trim(F.regexp_replace(reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(f" \\{x[1]} ")), LATEX.items(), text), r"\s+", " "))


# Operators that take limits, and signs at which a radicand ends.
BIG_OPERATORS = ("sum", "prod", "int", "oint", "coprod", "bigcup", "bigcap", "bigoplus", "bigotimes", "lim")
RADICAND_STOPS = ("+", "-", "=", "<", ">", "±", *(f"\\{n}" for n in ("leq", "geq", "neq", "approx", "equiv", "sim", "to", "in", "Rightarrow", "Leftarrow", "leftrightarrow", "propto", "pm", "mp")))
RADICAND_TOKENS = 6


def wrap_radicals(latex: Column) -> Column:
    """The tokens after \\sqrt in braces: a group or fraction alone, else up to the next sum or relation, six at most."""
    tokens = F.filter(F.split(latex, r"\s+"), lambda t: t != "")
    root, none = F.lit("\\sqrt"), F.lit(None).cast("array<string>")
    braced = lambda inner: F.concat(F.lit("\\sqrt{"), inner, F.lit("}"))
    closed = lambda s: F.when(s["rad"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.when(F.size(s["rad"]) == 0, root).otherwise(braced(F.array_join(s["rad"], " "))))))
    pair = lambda out, rad: F.struct(out.alias("out"), rad.alias("rad"))

    def step(s: Column, t: Column) -> Column:
        begun = lambda out: F.when(t == root, pair(out, F.array().cast("array<string>"))).otherwise(pair(F.concat(out, F.array(t)), none))
        group = (F.size(s["rad"]) == 0) & t.rlike(r"^(?:[{(]|\\frac)")
        full = t.isin(*RADICAND_STOPS) | (F.size(s["rad"]) == RADICAND_TOKENS)
        return F.when(s["rad"].isNull(), begun(s["out"])).when(group, pair(F.concat(s["out"], F.array(braced(t))), none)).when(full, begun(closed(s))).otherwise(pair(s["out"], F.concat(s["rad"], F.array(t))))

    return F.array_join(F.aggregate(tokens, pair(F.array().cast("array<string>"), none), step, closed), " ")


def attach_limits(latex: Column) -> Column:
    """A sub- and a superscript behind a large operator, in either order, join it: the subscript first."""
    names = "|".join(BIG_OPERATORS)
    one = F.trim(F.regexp_replace(latex, r"\s+", " "))
    below = F.regexp_replace(one, rf"(?<!\S)(\\(?:{names})) (_\{{\S*)(?: (\^\{{\S*))?(?!\S)", "$1$2$3")
    return F.regexp_replace(below, rf"(?<!\S)(\\(?:{names})) (\^\{{\S*)(?: (_\{{\S*))?(?!\S)", "$1$3$2")
