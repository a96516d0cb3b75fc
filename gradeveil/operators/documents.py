"""Identity and payment documents in recognised lines: which kind of document a picture shows, and where its secrets are.

Lines (text, confidence, bounds, words) and media boxes with hints stand in arrays of one row per picture. The decision
is a few dozen comparisons per picture, written as a pure Python function under a pandas UDF-like map.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from gradeveil.operators.classify import AADHAAR_GROUPS, AADHAAR_LABELLED, CARD_RUN, CARD_TERMS, CVV, DATE, EXPIRY, PAN, PRINTED

MIN_CONFIDENCE, MAX_MEDIA = 0.72, 8
#: Lines of a text in one card-shaped picture.
PICTURE_LINES = 12
FOUND = "id long, documents array<struct<kind:string,media:int,confidence:double>>, secrets array<struct<kind:string,secret:string,media:int,confidence:double,x:double,y:double,width:double,height:double>>"

# Captions of fields, and what tells a document's kind.
CAPTIONS = {
    "aadhaar-number": r"\b(?:aadhaar|aadhar)(?:\s+number)?\b\s*[:\-]?\s*",
    "name": r"\b(?:full\s+name|name)\b\s*[:\-]?\s*",
    "date-of-birth": r"\b(?:date\s+of\s+birth|dob|birth\s+date)\b\s*[:\-]?\s*",
    "gender": r"\b(?:gender|sex)\b\s*[:\-]?\s*",
    "address": r"\b(?:residential\s+address|address)\b\s*[:\-]?\s*",
    "mobile": r"\b(?:mobile|phone|telephone)\b\s*[:\-]?\s*",
}
AADHAAR_CONTEXT = r"\b(?:aadhaar|aadhar|uidai|unique\s+identification|identity\s+card|synthetic\s+identity)\b"
PAN_CONTEXT = r"\b(?:pan|permanent\s+account\s+number|income\s+tax|tax\s+department)\b"
CARD_PRINTED = r"\b(?:bank|card|cardholder|valid|thru|security|code|payment|instrument|synthetic|evaluation)\b"
AADHAAR_FIELDS = [
    (r"\b(?:date\s+of\s+birth|dob|year\s+of\s+birth)\b", "date-of-birth"),
    (r"\b(?:full\s+name|name)\s*[:\-]", "name"),
    (r"\b(?:gender|sex)\s*[:\-]", "gender"),
    (r"\b(?:address|residential\s+address)\s*[:\-]", "address"),
    (r"\b(?:mobile|phone|telephone)\s*[:\-]", "mobile"),
]
# The fields of each kind of document, and the least grade that hides them.
FIELDS = {"credit-card": ["card-number", "expiry", "cvv", "name"], "pan-card": ["pan", "name", "date-of-birth"], "aadhaar-card": ["aadhaar-number", "name", "date-of-birth", "gender", "mobile", "address"]}
NUMBERS = {"credit-card": "card-number", "pan-card": "pan", "aadhaar-card": "aadhaar-number"}
FIELD_GRADES = {"card-number": 1, "expiry": 1, "cvv": 1, "pan": 1, "aadhaar-number": 1, "date-of-birth": 2, "mobile": 2, "address": 2, "gender": 3, "name": 3}


def has(pattern: str, text: str) -> bool:
    return re.search(pattern, text, re.IGNORECASE) is not None


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        d = int(d) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return bool(digits) and total % 10 == 0


def has_card_number(text: str) -> bool:
    runs = re.findall(CARD_RUN, " ".join(text.split()), re.ASCII)
    return any(passes_luhn(re.sub(r"\D", "", r)) for r in runs)


def has_pan(text: str) -> bool:
    return has(PAN, text)


def has_aadhaar(text: str) -> bool:
    return has(AADHAAR_GROUPS, " ".join(text.split())) or has(AADHAAR_LABELLED, text)


def has_expiry(text: str) -> bool:
    return any(re.fullmatch("0?[1-9]|1[0-2]", part) for m in re.findall(EXPIRY, text) for part in (m, m[-1:], m[-2:]))


def is_bare_cvv(text: str) -> bool:
    return re.fullmatch(r"\D*\d{3,4}\D*", text) is not None


def is_date(text: str) -> bool:
    return has(DATE, text)


def is_name(text: str) -> bool:
    plain = " ".join(text.split())
    return len(plain.split()) >= 2 and re.fullmatch(r"[^\W\d_](?:[^\W\d_]|[.' -]){2,80}", plain) is not None and not has(PRINTED, plain)


class Box(tuple):
    """(x, y, width, height)"""

    @property
    def right(self) -> float:
        return self[0] + self[2]

    @property
    def bottom(self) -> float:
        return self[1] + self[3]

    @property
    def area(self) -> float:
        return self[2] * self[3]

    def common(self, other: Box) -> float:
        return max(0.0, min(self.right, other.right) - max(self[0], other[0])) * max(0.0, min(self.bottom, other.bottom) - max(self[1], other[1]))

    def share(self, other: Box) -> float:
        smaller = min(self.area, other.area)
        return self.common(other) / smaller if smaller > 0 else 0.0

    def near(self, other: Box) -> bool:
        gap = abs(self[1] + self[3] / 2 - other[1] - other[3] / 2)
        aside = abs(self[0] + self[2] / 2 - other[0] - other[2] / 2)
        return gap <= max(64, self[3] * 3) and aside <= max(self[2], other[2]) + 80

    @staticmethod
    def around(boxes: list[Box]) -> Box | None:
        if not boxes:
            return None
        x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
        return Box((x, y, max(b.right for b in boxes) - x, max(b.bottom for b in boxes) - y))


class Line:
    def __init__(self, text: str, confidence: float, box: Box, words: list[tuple[str, float, Box]]):
        self.text, self.confidence, self.box, self.words = text, confidence, box, words

    @classmethod
    def of(cls, row: dict) -> Line:
        """A weak line is read from its confident words alone."""
        words = [(w["text"], w["confidence"], Box((w["x"], w["y"], w["width"], w["height"]))) for w in (row.get("words") if row.get("words") is not None else [])]
        line = cls(row["text"], row["confidence"], Box((row["x"], row["y"], row["width"], row["height"])), words)
        sure = [w for w in words if w[1] >= MIN_CONFIDENCE]
        if line.confidence < MIN_CONFIDENCE and sure:
            line.text, line.confidence = " ".join(w[0] for w in sure), sum(w[1] for w in sure) / len(sure)
        return line

    def words_like(self, test: Callable[[str], bool]) -> Box:
        return Box.around([b for t, _, b in self.words if test(t)]) or self.box

    def behind_caption(self, secret: str) -> Box:
        """The box of the value behind a caption: that of its words, else its share of the line's width."""
        found = re.search(CAPTIONS[secret], self.text, re.IGNORECASE) if secret in CAPTIONS else None
        if not found or found.end() >= len(self.text):
            return self.box
        caption = len(self.text[: found.end()].split())
        if len(self.words) > caption and " ".join(w[0] for w in self.words) == self.text:
            return Box.around([b for _, _, b in self.words[caption:]])
        x = self.box[0] + self.box[2] * found.end() / len(self.text)
        return Box((x, self.box[1], max(1.0, self.box.right - x), self.box[3]))


def _topmost(lines: Iterable[Line]) -> Line | None:
    return min(lines, key=lambda c: c.box[1], default=None)


def _labelled(lines: list[Line], secret: str, test: Callable[[str], bool]) -> tuple[Line, Box] | None:
    bare = lambda text: re.sub(CAPTIONS[secret], "", text, count=1, flags=re.IGNORECASE)
    only = lambda text: re.sub(r"[:\-\s]", "", bare(text)) == ""
    for c in lines:
        if has(CAPTIONS[secret], c.text) and not only(c.text) and test(bare(c.text)):
            return c, c.behind_caption(secret)
    label = next((c for c in lines if only(c.text)), None)
    if label is None:
        return None
    below = _topmost(c for c in lines if c is not label and test(c.text) and -4 <= c.box[1] - label.box.bottom <= max(90, label.box[3] * 4) and abs(c.box[0] - label.box[0]) <= max(120, label.box[2]))
    return (below, below.box) if below else None


def _below(lines: list[Line], pan: Line, test: Callable[[str], bool]) -> tuple[Line, Box] | None:
    found = _topmost(c for c in lines if c is not pan and test(c.text) and -6 <= c.box[1] - pan.box.bottom <= max(220, pan.box[3] * 12))
    return (found, found.box) if found else None


def _cardholder(lines: list[Line], number: Line) -> tuple[Line, Box] | None:
    if found := _labelled(lines, "name", is_name):
        return found
    for c in lines:
        if c.box[1] < number.box.bottom:
            continue
        words = []
        for w in c.words:
            if has(r"\d", w[0]):
                break
            if not re.fullmatch(r"(?:cardholder|name)[:\-]?", w[0], re.IGNORECASE):
                words.append(w)
        text = " ".join(w[0] for w in words) if words else c.text
        if is_name(text) and not has(CARD_PRINTED, text):
            return c, Box.around([w[2] for w in words]) or c.box
    return None


def classify(lines: list[Line], media: list[tuple[Box, str | None]]) -> tuple[list[dict], list[dict]]:
    """media: boxes with the document type that a hint gives, or None. A picture without confident evidence of all that
    its kind must have gives nothing, and so stays masked as a whole."""
    documents, secrets = [], []
    for number, (box, hint) in enumerate(media[:MAX_MEDIA]):
        if box[3] <= 0 or not 1.2 <= box[2] / box[3] <= 2.4:
            continue
        inside = [c for c in lines if c.confidence >= MIN_CONFIDENCE and c.box.common(box) >= 0.45 * min(c.box.area, box.area)]
        if not inside:
            continue
        text = " ".join(c.text for c in inside)
        confidence = min(1.0, max(0.0, sum(c.confidence for c in inside) / len(inside)))
        first = lambda test, inside=inside: next((c for c in inside if test(c.text)), None)
        aadhaar, pan, card = first(has_aadhaar), first(has_pan), first(has_card_number)

        def secret(kind: str, name: str, line: Line, at: Box, number: int = number) -> dict:
            return {"kind": kind, "secret": name, "media": number, "confidence": line.confidence, "x": at[0], "y": at[1], "width": at[2], "height": at[3]}

        if aadhaar and has(AADHAAR_CONTEXT, text):
            documents.append({"kind": "aadhaar-card", "media": number, "confidence": confidence})
            for c in inside:
                name = "aadhaar-number" if has_aadhaar(c.text) else next((n for p, n in AADHAAR_FIELDS if has(p, c.text)), None)
                if name:
                    secrets.append(secret("aadhaar-card", name, c, c.behind_caption(name)))
        elif pan and has(PAN_CONTEXT, text):
            documents.append({"kind": "pan-card", "media": number, "confidence": confidence})
            secrets.append(secret("pan-card", "pan", pan, pan.words_like(has_pan)))
            for name, test in (("name", is_name), ("date-of-birth", is_date)):
                found = _labelled(inside, name, test) or (_below(inside, pan, test) if hint == "pan-card" else None)
                if found:
                    secrets.append(secret("pan-card", name, *found))
        elif card and (hint == "credit-card" or sum(has(rf"\b{t}\b", text) for t in CARD_TERMS) >= 2):
            own = [secret("sensitive-field", "card-number", card, card.words_like(lambda t: re.fullmatch(r"\d{3,19}", t.strip()) is not None))]
            dates = [c.box for c in inside if has_expiry(c.text)]
            labels = [c.box for c in inside if has(r"\b(?:cvv|cvc|security\s+code)\b", c.text)]
            for c in inside:
                if c is card:
                    continue
                if has_expiry(c.text):
                    own.append(secret("sensitive-field", "expiry", c, c.words_like(has_expiry)))
                bare = [b for t, _, b in c.words if is_bare_cvv(t)]
                hinted = bare[-1] if bare and hint == "credit-card" and any(d.near(c.box) for d in dates) else None
                beside = bare and any(b.near(bare[0]) for b in labels)
                alone = is_bare_cvv(c.text) and any(b.near(c.box) for b in labels)
                if has(CVV, c.text) or beside or hinted or alone:
                    own.append(secret("sensitive-field", "cvv", c, bare[0] if bare else hinted or c.words_like(is_bare_cvv)))
            if holder := _cardholder(inside, card):
                own.append(secret("sensitive-field", "name", *holder))
            if {"card-number", "expiry", "cvv"} <= {s["secret"] for s in own}:
                documents.append({"kind": "credit-card", "media": number, "confidence": confidence})
                secrets += own
    kept: list[dict] = []
    for s in secrets:
        if not any(k["secret"] == s["secret"] and all(abs(k[side] - s[side]) < 0.5 for side in ("x", "y", "width", "height")) for k in kept):
            kept.append(s)
    return documents, kept


def classify_documents(pictures: DataFrame) -> DataFrame:
    """Rows of id, lines (array of struct of text, confidence, x, y, width, height, words) and media (array of struct of
    x, y, width, height, hint) give id, documents and secrets. Null arrays are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, lines, media in zip(batch["id"], batch["lines"], batch["media"], strict=True):
                read = [Line.of(dict(x)) for x in (lines if lines is not None else [])]
                boxes = [(Box((m["x"], m["y"], m["width"], m["height"])), m["hint"]) for m in (media if media is not None else [])]
                out.append((id_, *classify(read, boxes)))
            yield pd.DataFrame(out, columns=["id", "documents", "secrets"])

    return pictures.select("id", "lines", "media").mapInPandas(run, FOUND)


def classify_text(text: str) -> tuple[list[dict], list[dict]]:
    """A text as card-shaped pictures: every PICTURE_LINES lines in a row are one, so that no border parts what stands
    together. A secret that several pictures show counts once, a document by the line of its number."""
    lines = [Line(t, 0.9, Box((10.0, i * 20.0 + 10, 380.0, 16.0)), []) for i, t in enumerate(text.split("\n"))]
    numbers = [i for i, c in enumerate(lines) if has_card_number(c.text) or has_pan(c.text) or has_aadhaar(c.text)]
    last = max(0, len(lines) - PICTURE_LINES)
    documents, secrets = {}, {}
    # without a number a picture shows no document
    for begin in sorted({b for i in numbers for b in range(max(0, i - PICTURE_LINES + 1), min(i, last) + 1)}):
        media = [(Box((0.0, begin * 20.0, 400.0, PICTURE_LINES * 20.0 + 20)), "credit-card")]
        found, own = classify(lines[begin : begin + PICTURE_LINES], media)
        for d in found:
            at = min(s["y"] for s in own if s["secret"] == NUMBERS[d["kind"]])
            documents.setdefault((d["kind"], at), d)
        for s in own:
            secrets.setdefault((s["secret"], s["x"], s["y"], s["width"]), s)
    return list(documents.values()), list(secrets.values())


def classify_texts(texts: DataFrame) -> DataFrame:
    """Rows of id and text give id, documents and secrets of the whole text. A null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(id_, *classify_text(text if isinstance(text, str) else "")) for id_, text in zip(batch["id"], batch["text"], strict=True)]
            yield pd.DataFrame(out, columns=["id", "documents", "secrets"])

    return texts.select("id", "text").mapInPandas(run, FOUND)


def covered(kind: str, found: Iterable[str], grade: int) -> bool:
    """Whether the secrets found in a picture are all that its kind must show at a grade."""
    return {f for f in FIELDS[kind] if FIELD_GRADES[f] <= grade} <= set(found)
