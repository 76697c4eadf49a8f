"""Secret scans by assignment-aware lexing.

Three plain patterns give the base spans (leftmost, not overlapping, each kind on its own):

* ``assign``: a sensitive word, an optional quote, ``:`` or ``=``, and a value of 8 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 16 or more characters;
* ``hex``: 32 or more hexadecimal digits.

The method adds ``lexed`` spans: assignments of source and configuration syntax (``name = value``,
``name: value``, ``name => value``, ``name := value``, with a type annotation, as a subscript, also after ``export``, ``set``,
``const`` and the like) are read into (name, expression) pairs.  An expression is a literal (triple quotes included), a name, or a
sum of these, in parentheses or not, continued on the next line or not; constants are
propagated, so a name that holds a literal hands it on, and joined parts count as one literal.  A literal
is scored by its target's name (sensitive words, less a part for each word that marks public or placeholder values), by
its length and variety of characters; a literal of nothing but placeholder words scores nothing.  From ``threshold`` on, the
spans of its literals are reported, unless a base span of the same text covers them.

Spans are in code points, end exclusive; order is by start, then by kind as listed.

Edge cases: null and empty texts have no spans; repeated rows give one row each; null ids are
passed on; texts are scanned whole, whatever their length; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs shorter than the limit cannot hold a match, so the limit stands in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: A name (a subscript's too), a type where one is declared, its operator and the start of what follows.
_TYPE = r"""[&*]?[A-Za-z_][\w.]{0,40}(?:[<\[][\w.,\x20|<>]{0,40}[>\]])?\??"""
PAIR = re.compile(
    rf"""(?:(?<![\w.$-])["']?|(?<=\[["']))([A-Za-z_$][\w.$-]*)["']?\]?
    (?:[\x20\t]*:[\x20\t]*{_TYPE}[\x20\t]*=(?![=~>])
      |(?:(?<=[\w$])[\x20\t]+{_TYPE})?[\x20\t]*(?::=|=>|=(?![=~])|:(?![:/])))
    [\x20\t]*(?=[("'`\w$])""", re.A | re.X)
#: What declares a name and its type without a colon.
DECLARES = re.compile(r"(?:var|let|const|val)[\x20\t]+\Z")
LITERAL = re.compile(
    r"""\"{3}(.*?)\"{3}|'{3}(.*?)'{3}|"((?:[^"\\\r\n]|\\.)*)"|'((?:[^'\\\r\n]|\\.)*)'|`([^`\r\n]*)`""", re.S)
NAME = re.compile(r"[A-Za-z_$][\w.$-]*", re.A)
BARE = re.compile(r"[A-Za-z0-9+/_.=~!@#%^&*-]+", re.A)
_LINE = r"(?:\\?\r?\n[\x20\t]*)?"
PLUS = re.compile(rf"[\x20\t]*{_LINE}(?:\+(?!\+)|\.\.?(?=[\x20\t\"'])|&(?!&))[\x20\t]*{_LINE}")
#: Between literals in parentheses nothing need stand.
BESIDE = re.compile(r"\s*(?:\\\r?\n\s*)?(?=[\"'`])")
OPEN = re.compile(r"\([\x20\t]*(?:\r?\n[\x20\t]*)?")
#: Parts of names that mark a secret, and how strongly.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.6, "access": 0.4, "auth": 0.7,
    "authorization": 0.8, "bearer": 0.9, "session": 0.4, "signature": 0.6, "signing": 0.6, "encryption": 0.7,
    "salt": 0.6, "cookie": 0.4, "key": 0.5, "api": 0.3, "client": 0.2, "webhook": 0.5, "dsn": 0.6,
}
#: Parts of names or literals that mark something public or a placeholder, and how much they take off a name.
HARMLESS = dict.fromkeys(
    "public example sample test dummy placeholder changeme none null true false your xxx".split(), 0.3) | dict.fromkeys(
    "name path file url uri type length size count id field header label prefix suffix regex pattern format".split(), 0.1)
CUT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def name_score(name: str) -> float:
    """How sensitive a target name is, from 0 to 1; every harmless word takes something off."""
    parts = [p.lower() for p in CUT.split(name) if p]
    score = sum(SENSITIVE.get(p, 0.0) for p in parts)
    if "key" in parts and {"api", "private", "access", "secret", "signing", "encryption", "auth"} & set(parts):
        score += 0.3
    return max(0.0, min(1.0, score) - sum(HARMLESS.get(p, 0.0) for p in parts))


def literal_score(literal: str) -> float:
    """How much a literal looks like a secret: its length and the entropy of its characters; several words count half."""
    n = len(literal)
    words = [x.lower() for x in CUT.split(literal) if x]
    if n < 8 or (words and all(w in HARMLESS for w in words)):
        return 0.0
    if " " in literal and (literal.count(" ") < 2 or any(w in HARMLESS for w in words)):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in map(literal.count, set(literal)))
    mixed = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 4) * (0.5 + mixed / 8) * (0.5 if " " in literal else 1.0)


def expression(text: str, start: int, known: dict[str, tuple[str, list[tuple[int, int]]]]):
    """The constant value from a place on, its literal spans, whether any was quoted, and where it ends; None when unknown."""
    value, found, quoted, at = "", [], False, start
    inside = OPEN.match(text, at)
    if inside:
        at = inside.end()
    while True:
        literal = LITERAL.match(text, at)
        if literal:
            group = literal.lastindex
            value += literal[group]
            found.append(literal.span(group))
            quoted, at = True, literal.end()
        else:
            name = NAME.match(text, at)
            if name and name[0] in known:
                value += known[name[0]][0]
                found += known[name[0]][1]
                quoted, at = True, name.end()
            else:
                bare = None if inside else BARE.match(text, at)
                if not bare or value:
                    return (value, found, quoted, at) if found else None
                word = bare[0].rstrip(".=,")
                return word, [(bare.start(), bare.start() + len(word))], False, bare.end()
        plus = PLUS.match(text, at) or (inside and BESIDE.match(text, at))
        if not plus:
            return value, found, quoted, at
        at = plus.end()


def lexed(text: str, threshold: float) -> list[tuple[int, int]]:
    """Spans of literals assigned to sensitive names, after constant propagation."""
    known: dict[str, tuple[str, list[tuple[int, int]]]] = {}
    out: set[tuple[int, int]] = set()
    at = 0
    while pair := PAIR.search(text, at):
        at = pair.end()
        spaced = re.match(r"[\x20\t]+[&*A-Za-z_]", text[pair.end(1) : pair.end()])
        if spaced and not DECLARES.search(text, max(0, pair.start() - 12), pair.start(1)):
            at = pair.end(1)  # two words of prose; the second one may be a name itself
            continue
        held = expression(text, at, known)
        if held is None:
            known.pop(pair[1], None)
            continue
        value, found, quoted, end = held
        if quoted:
            known[pair[1]] = value, found
            at = max(at, end)
        else:
            known.pop(pair[1], None)
        weight = name_score(pair[1])
        # A bare word may be prose or a call, so it needs a digit.
        if weight and (quoted or re.search("[0-9]", value)) and weight * literal_score(value) >= threshold:
            out.update(s for s in found if s[1] > s[0])
    return sorted(out)


def scan(text: str, threshold: float = 0.3) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)``."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        base = list(spans)
        spans += [("lexed", a, b) for a, b in lexed(text, threshold)
                  if not any(s <= a and b <= e for _, s, e in base)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, spans`` with ``spans`` an array of ``(kind, start, end)``, for every row of ``docs``."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t or "", threshold)]
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")
