"""Equation scripts of Hangul documents as Office MathML text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
#: Words that stand for one sign: Greek letters by their names, the rest fixed values.
SIGNS = {
    "inf": "∞", "infty": "∞", "partial": "∂", "times": "×", "cdot": "⋅", "pm": "±", "mp": "∓", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "equiv": "≡", "propto": "∝", "forall": "∀", "exists": "∃", "nabla": "∇",
    "in": "∈", "notin": "∉", "subset": "⊂", "supset": "⊃", "cup": "∪", "cap": "∩", "vee": "∨", "wedge": "∧", "oplus": "⊕", "otimes": "⊗", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "Leftarrow": "⇐",
    "leftrightarrow": "↔", "therefore": "∴", "because": "∵",
}
for _n in _NAMES:
    _w = "lambda" if _n == "lamda" else _n
    SIGNS[_w] = unicodedata.lookup(f"GREEK SMALL LETTER {_n.upper()}")
    SIGNS[_w.capitalize()] = unicodedata.lookup(f"GREEK CAPITAL LETTER {_n.upper()}")
#: Combining marks over a letter, and operators with limits (fixed values).
ACCENTS = {"bar": "̄", "hat": "̂", "dot": "̇", "ddot": "̈", "tilde": "̃", "vec": "⃗", "check": "̌"}
BIG = {"sum": "∑", "prod": "∏", "int": "∫"}
_TOKEN = re.compile(r'"([^"]*)"|(##|[A-Za-z]+|\d+(?:\.\d+)?|[~`]|\S)')


def _run(text: str, roman: bool = False) -> str:
    return f"<m:r>{'<m:rPr><m:sty m:val="p"/></m:rPr>' if roman else ''}<m:t>{escape(text)}</m:t></m:r>"


class _Script:
    """One pass over the tokens; every method returns the MathML of what it has read."""

    def __init__(self, script: str):
        self.tokens = [("text", m[1]) if m[1] is not None else ("word", m[2]) for m in _TOKEN.finditer(script)]
        self.at = 0

    def next_is(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "word" and self.tokens[self.at][1] in words

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("script ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def until(self, *ends: str) -> str:
        out = []
        while self.at < len(self.tokens) and not self.next_is(*ends):
            item = self.scripted()
            while self.next_is("over"):
                self.take()
                item = f"<m:f><m:num>{item}</m:num><m:den>{self.scripted()}</m:den></m:f>"
            out.append(item)
        return "".join(out)

    def group(self, end: str) -> str:
        inside = self.until(end)
        if not self.next_is(end):
            raise ValueError(f"no {end}")
        self.take()
        return inside

    def scripted(self) -> str:
        base = self.single()
        parts = {}
        while self.next_is("^", "_"):
            mark = self.take()[1]
            parts[mark] = self.single()
        if len(parts) == 2:
            return f"<m:sSubSup><m:e>{base}</m:e><m:sub>{parts['_']}</m:sub><m:sup>{parts['^']}</m:sup></m:sSubSup>"
        if "^" in parts:
            return f"<m:sSup><m:e>{base}</m:e><m:sup>{parts['^']}</m:sup></m:sSup>"
        return f"<m:sSub><m:e>{base}</m:e><m:sub>{parts['_']}</m:sub></m:sSub>" if parts else base

    def single(self) -> str:
        kind, word = self.take()
        low = word.lower()
        if kind == "text":
            return _run(word, True)
        if word in "~`":
            return _run(" " if word == "~" else " ")
        if word == "{":
            return self.group("}")
        if word == "(":
            return _run("(") + self.group(")") + _run(")")
        if low in BIG and low != "int" or word in ("int", "INT"):
            return self.big(BIG[low])
        if word == "cases":
            self.take()
            rows = [self.until("##", "}")]
            while self.next_is("##"):
                self.take()
                rows.append(self.until("##", "}"))
            self.take()
            return '<m:d><m:dPr><m:begChr m:val="{"/><m:endChr m:val=""/></m:dPr><m:e><m:eqArr>' + "".join(f"<m:e>{r}</m:e>" for r in rows) + "</m:eqArr></m:e></m:d>"
        if word == "sqrt":
            return f'<m:rad><m:radPr><m:degHide m:val="1"/></m:radPr><m:deg/><m:e>{self.single()}</m:e></m:rad>'
        if word in ACCENTS:
            return f'<m:acc><m:accPr><m:chr m:val="{ACCENTS[word]}"/></m:accPr><m:e>{self.single()}</m:e></m:acc>'
        if word in ("LEFT", "left"):
            opening = self.take()[1]
            inside = self.until("RIGHT", "right")
            self.take()
            closing = self.take()[1]
            plain = {"langle": "⟨", "rangle": "⟩"}
            return f'<m:d><m:dPr><m:begChr m:val="{escape(plain.get(opening, opening))}"/><m:endChr m:val="{escape(plain.get(closing, closing))}"/></m:dPr><m:e>{inside}</m:e></m:d>'
        if word == "rm":
            return re.sub(r"<m:r>(?=<m:t>)", '<m:r><m:rPr><m:sty m:val="p"/></m:rPr>', self.single())
        return _run(SIGNS.get(word, word), low in ("max", "min"))

    def big(self, sign: str) -> str:
        low = high = ""
        while self.next_is("from", "to", "_", "^"):
            which = self.take()[1]
            if which in ("from", "_"):
                low = self.single()
            else:
                high = self.single()
        return f'<m:nary><m:naryPr><m:chr m:val="{sign}"/></m:naryPr><m:sub>{low}</m:sub><m:sup>{high}</m:sup><m:e>{self.scripted() if self.at < len(self.tokens) else ""}</m:e></m:nary>'


def omml(script: str) -> str:
    """The MathML of a script; what cannot be read becomes its text."""
    try:
        reader = _Script(script.strip())
        inside = reader.until()
    except (ValueError, KeyError):
        inside = _run(script.strip())
    return f"<m:oMath>{inside}</m:oMath>"


def equation(script: Column) -> Column:
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield texts.map(lambda t: None if t is None else omml(t))

    return F.pandas_udf(run, "string")(script)
