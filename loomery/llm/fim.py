"""Fill-in-the-middle: a text becomes prefix, suffix and middle under markers, and can be rebuilt exactly."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT = r"(?s:.)"
MARKERS = ("<P>", "<S>", "<M>")
RUN = 256  # units that one match of the scanner takes together

MADE = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_scanner(unit: str):
    """A function from a text to the ends of its units (matches of ``unit``, from left to right), as a compact array.

    ``finditer`` yields runs of adjoining units, and each match lists the ends of its units, so there is one match object
    per ``RUN`` units. Units must not be empty.
    """
    import regex

    if regex.compile(unit).fullmatch(""):
        raise ValueError("a unit must take at least one character")
    runs = regex.compile(rf"(?:(?P<_unit>{unit})){{1,{RUN}}}+").finditer

    def ends(text: str) -> array:
        out = array("I" if len(text) < 1 << 32 else "Q")
        for m in runs(text):
            out.extend(m.ends("_unit"))
        return out

    return ends


def draws(key: str) -> tuple[int, int, int, int]:
    """The first four 32-bit groups of the key's SHA-256."""
    raw = hashlib.sha256(key.encode()).digest()
    return tuple(int.from_bytes(raw[k : k + 4], "big") for k in (0, 4, 8, 12))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def cut(text: str, ends: array, h: tuple[int, int, int, int], plain: int, spm: int, markers: tuple[str, str, str]):
    """(form, characters before the middle, characters of the middle, output) of one text."""
    p, s, m = markers
    n = len(ends)
    if not text or any(x in text for x in markers) or h[2] % 100 >= plain:
        return "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (lo, hi))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def rebuild(output: str, form: str, markers: tuple[str, str, str] = MARKERS) -> str:
    """The text that an output of this form came from. A marker never stands in a part, so the first one found is right."""
    if form == "plain":
        return output
    p, s, m = markers
    first, second = (p, s) if form == "psm" else (s, p)
    a, rest = output[len(first) :].split(second, 1)
    b, middle = rest.split(m, 1)
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return prefix + middle + suffix


def _transform(unit: str, seed: str, plain: int, spm: int, markers: tuple[str, str, str], keep: bool):
    @F.pandas_udf(MADE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scan = unit_scanner(unit)
        for keys, texts in batches:
            rows = []
            for key, text in zip(keys, texts):
                text = text if isinstance(text, str) else ""
                ends = scan(text)
                form, before, inside, out = cut(text, ends, draws(f"{seed}:{key if isinstance(key, str) else ''}"), plain, spm, markers)
                rows.append((len(ends), form, before, inside, out if keep else None, _sha(out), _sha(rebuild(out, form, markers))))
            made = pd.DataFrame(rows, columns=[c.split()[0] for c in MADE.split(", ")])
            yield made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def fill_in_middle(
    docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, plain_from: int = 90, spm_below: int = 20,
    markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text", with_output: bool = True,
) -> DataFrame:
    """A row per document: doc_id, n (units), form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    Draws come from the SHA-256 of ``seed:doc_id`` alone, so reruns agree. Of 100 draws those from ``plain_from`` on leave the text
    plain; of the others those under ``spm_below`` put the suffix first. Characters between units go with the part in which they
    stand; what follows the last unit is suffix. A text that is empty or holds a marker is plain. ``restored_sha256`` is of the text
    rebuilt from output and form; :func:`restored` gives that text as a column.

    Null texts are empty. Rows without an id share the draws of the empty id. Equal rows give equal rows; an empty table
    gives none; other columns are not looked at. Each row is a task's own, whatever repeats; no row moves. A text of any length is
    cut whole, with four bytes a unit beside it.
    """
    p, s, m = markers
    if len({p, s, m}) < 3 or any(a in b for a in markers for b in markers if a is not b) or not all(markers) or any(a.endswith(b[:k]) for a in markers for b in markers for k in range(1, len(b))):
        raise ValueError("markers must differ, and none may end as one begins")
    made = _transform(unit, str(seed), plain_from, spm_below, tuple(markers), with_output)
    rows = docs.select(F.col(id_col).cast("string").alias("_key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    out = rows.select("doc_id", made("_key", "_text").alias("_made")).select("doc_id", "_made.*")
    return out if with_output else out.drop("output")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The original text, from the output and its form."""

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([rebuild(o, f, markers) for o, f in zip(outputs, forms)], dtype=object)

    return run(output, form)
