"""Titles with formulas as plain text: MathML and LaTeX as Unicode, all capitals as words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .places import MARK, bound

#: LaTeX names of letters and signs, and digits and signs that have raised and lowered forms.
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ",
    "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω", "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
}
SIGNS = {"to": "→", "rightarrow": "→", "pm": "±", "times": "×", "cdot": "·", "sim": "∼", "approx": "≈", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "infty": "∞", "ell": "ℓ", "hbar": "ℏ", "bar": "", "overline": "", "sqrt": "√"}
PLAIN, RAISED, LOWERED = "0123456789+-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "₀₁₂₃₄₅₆₇₈₉₊₋"


def has_latex(text: Column) -> Column:
    """Whether a text holds a formula between dollar signs or a LaTeX command."""
    return F.coalesce(F.rlike(text, F.lit(r"\$[^$]+\$|\\[A-Za-z]+|\\\(")), F.lit(False))


def _scripts(text: Column, sign: str, forms: str) -> Column:
    """Digits after a sign in their raised or lowered form, one at a time or in braces of up to six."""
    marked = F.regexp_replace(text, rf"\{sign}(?:\{{([0-9+-]{{1,6}})\}}|([0-9+-]))", f"{MARK}$1$2{MARK}")
    shown = F.array_join(F.transform(F.split(marked, MARK, -1), lambda x, i: F.when(i % 2 == 1, F.translate(x, PLAIN, forms)).otherwise(x)), "")
    return F.when(F.contains(text, F.lit(sign)), shown).otherwise(text)


def _named(text: Column) -> Column:
    """LaTeX names of letters and signs as these; a blank behind a name goes with it. Other commands stay."""
    known = F.create_map(*(F.lit(x) for kv in {**GREEK, **SIGNS}.items() for x in kv))

    def one(cut: Column, i: Column) -> Column:
        name = F.get(cut, i + 1)
        return F.concat(F.get(cut, i), F.coalesce(F.try_element_at(known, name), F.concat(F.lit("\\"), name, F.get(cut, i + 2)), F.lit("")))

    marked = F.regexp_replace(text, r"\\([A-Za-z]+)(\s?)", f"{MARK}$1{MARK}$2{MARK}")
    shown = bound(F.split(marked, MARK, -1), lambda cut: F.array_join(F.transform(F.sequence(F.lit(0), F.size(cut) - 1, F.lit(3)), lambda i: one(cut, i)), ""))
    return F.when(F.contains(text, F.lit("\\")), shown).otherwise(text)


def plain_title(title: Column) -> Column:
    """A title without markup: tags go (what stands in sub and sup as lowered and raised digits), LaTeX letters and signs as Unicode, other
    commands and braces go, a title in capitals alone as words. Null stays null."""
    return bound(title, _plain)


def _plain(title: Column) -> Column:
    out = F.regexp_replace(title, r"(?i)<(?:\w+:)?m?sup>\s*([^<]{1,6}?)\s*</(?:\w+:)?m?sup>", "^{$1}")
    out = F.regexp_replace(out, r"(?i)<(?:\w+:)?m?sub>\s*([^<]{1,6}?)\s*</(?:\w+:)?m?sub>", "_{$1}")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    out = bound(_named(out), lambda x: bound(_scripts(x, "^", RAISED), lambda y: _scripts(y, "_", LOWERED)))
    out = F.regexp_replace(F.regexp_replace(out, r"\\[A-Za-z]+\s?", ""), r"[{}$]", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    capitals = lambda x: ~F.rlike(x, F.lit(r"\p{Ll}")) & F.rlike(x, F.lit(r"\p{Lu}{4,}.*\s.*\p{Lu}{2,}"))
    return bound(out, lambda x: F.when(capitals(x), F.initcap(x)).otherwise(x))
