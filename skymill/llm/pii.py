"""Personal data in texts, also where it is disguised.

Plain matching finds e-mail addresses, IPv4 addresses, payment cards and phone numbers. Deobfuscation then rewrites a
text by transducers that keep, for every character of the result, the source span that it came from: look-alike letters
and digits, invisible characters, spelled digits and written-out "at", "dot" and "plus". The same matchers run over the
rewritten text and their spans are mapped back; those that touch no plain span of their kind are added.

Offsets count code points, ends are exclusive. Null and empty texts have no spans. Equal texts have equal spans. An empty
table gives an empty result. Other columns, whatever their names, are not read, or stay where documents are returned. The
work on a text grows with its length, and with the logarithm of its spans.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, text_list

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = r"[A-Za-z0-9._%+-]"
_ADDRESS = _LOCAL + r"++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_ADDRESS_HERE = re.compile(_ADDRESS).match
_ADDRESS_NEXT = re.compile(f"(?<!{_LOCAL})" + _ADDRESS).search
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer


def find_emails(text: str) -> list[Span]:
    """A run of address characters is tried once, at its start or where the last match ended: other starts in it fail alike."""
    out, at = [], 0
    if "@" not in text:
        return out
    while m := (_ADDRESS_HERE(text, at) or _ADDRESS_NEXT(text, at)):
        out.append(m.span())
        at = m.end()
    return out


def find_ips(text: str) -> list[Span]:
    return [m.span() for m in _IP(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def find_cards(text: str) -> list[Span]:
    out = []
    for m in _CARD(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(m.span())
    return out


def find_phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


FINDERS: dict[str, Callable[[str], list[Span]]] = {"email": find_emails, "ip": find_ips, "card": find_cards, "phone": find_phones}

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɡ": "g", "ı": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
#: Characters without width.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Digits as words, in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: How the marks of an address are written out.
AT_WORDS, DOT_WORDS = "at arroba arobase", "dot punto punkt point"

#: Characters that may stand for an ASCII one or for nothing: a quick test before the slow path.
_ODD = re.compile("[" + re.escape("".join(LOOK_ALIKES) + INVISIBLE) + "\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u2460-\u24ff\u2070-\u209c\uff01-\uff5e\U0001d400-\U0001d7ff]")


def _one_of(words: list[str]) -> str:
    """A pattern of the words by their beginnings, which is searched for several times faster than a list of them; of two the longer."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    longer = [re.escape(h) + (_one_of(rest) if any(rest) else "") for h, rest in heads.items() if h]
    return "(?:" + "|".join(longer) + ")" + ("?" if "" in heads else "")


_DIGIT = _one_of([*DIGIT_WORDS])
_AT, _DOT = ("(?:" + "|".join(w.split()) + ")" for w in (AT_WORDS, DOT_WORDS))
_GAP = r"[ \t,./_-]{0,3}"
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:(?:plus|\+){_GAP})?(?:{_DIGIT}(?![A-Za-z])|[0-9]+)(?:{_GAP}(?<![A-Za-z])(?:{_DIGIT}(?![A-Za-z])|[0-9]+|double(?![A-Za-z])|triple(?![A-Za-z])))+", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"plus|\+|double|triple|{_DIGIT}|[0-9]+|.", re.IGNORECASE)
_DIGIT_HINT = re.compile(rf"(?<![A-Za-z]){_DIGIT}(?![A-Za-z])", re.IGNORECASE)
#: A digit word beside another or a number, in a text without capitals: any run of them holds such two.
_SPELLED_HINT = re.compile(rf"(?<![a-z])(?:{_DIGIT}{_GAP}(?<![a-z])(?:{_DIGIT}(?![a-z])|[0-9]|double|triple)|(?:[0-9]|double|triple){_GAP}(?<![a-z]){_DIGIT}(?![a-z]))")
_BRACKETED = re.compile(rf"[ \t]{{0,4}}[(\[{{<][ \t]{{0,4}}(?:({_AT}|@)|({_DOT}|\.))[ \t]{{0,4}}[)\]}}>][ \t]{{0,4}}", re.IGNORECASE)
_HOST = r"[A-Za-z0-9-]{1,63}"
#: Last parts of host names that make three written-out words an address: generic ones, and all country codes. Bracketed marks need none of them.
GENERIC_LEVELS = "com org net edu gov mil int info biz name pro mobi jobs travel museum aero coop cat tel asia post arpa app dev blog cloud club email life live media news online page shop site space store studio systems team tech today top website wiki work world xyz example test invalid local"
COUNTRY_CODES = (
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu "
    "cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id "
    "ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms "
    "mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk "
    "sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
)
#: Words that make what follows an ordinary "dot": "look at the dot in the middle".
ARTICLES = "a an the this that these those each every any some no one my your his her its our their another which what der die das den dem ein eine einen einem le la les un une el los las una"
_TOP = "(?:" + "|".join([*GENERIC_LEVELS.split(), *COUNTRY_CODES.split()]) + ")(?![A-Za-z0-9])"
#: A name with a digit or an inner mark goes before any host; others not before one that is an article.
#: Out of brackets "point" is left to prose ("at boiling point is").
_AT_WORD, _DOT_WORD = rf"[ \t]+{_AT}[ \t]+", r"[ \t]+(?:dot|punto|punkt)[ \t]+"
_NAME_OR_HOST = rf"(?:(?=(?:[A-Za-z_%+-]*[0-9]|[A-Za-z0-9]+(?:[._%+-]|{_DOT_WORD})[A-Za-z0-9]))|(?![A-Za-z0-9_%+-]+(?:{_AT_WORD}|@)(?:" + "|".join(ARTICLES.split()) + rf"){_DOT_WORD}))"
_WRITTEN = re.compile(rf"(?<![A-Za-z0-9._%+-]){_NAME_OR_HOST}(?:[A-Za-z0-9_%+-]{{1,64}}{_DOT_WORD}|[A-Za-z0-9_%+-]{{1,64}}\.){{0,4}}[A-Za-z0-9_%+-]{{1,64}}(?:{_AT_WORD}|@){_HOST}(?:(?:{_DOT_WORD}|\.){_HOST}){{0,4}}{_DOT_WORD}{_TOP}", re.IGNORECASE)
_WRITTEN_PART = re.compile(rf"[ \t]+(?:({_AT})|dot|punto|punkt)[ \t]+", re.IGNORECASE)
_DOT_HINT = re.compile(r"[ \t](?:dot|punto|punkt)[ \t]", re.IGNORECASE)
#: A name with a digit or an inner mark before a lone "at", or an "@" between spaces, and a host with a lettered end.
_MAILBOX_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])(?=[A-Za-z0-9._%+-]{{0,64}}[0-9._+-][A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,64}}(?<![._%+-])(?P<at>{_AT_WORD}|[ \t]+@[ \t]*|@[ \t]+)(?:[A-Za-z0-9-]{{1,63}}\.){{1,5}}[A-Za-z]{{2,24}}(?![A-Za-z0-9])", re.IGNORECASE)
_AT_HINT = re.compile(rf"[ \t]{_AT}[ \t]|[ \t]@|@[ \t]", re.IGNORECASE)
#: Character references for the two marks of an address.
_REFERENCES = re.compile(r"&#0*64;|&#x0*40;|&commat;|%40|(&#0*46;|&#x0*2e;|&period;)", re.IGNORECASE)
#: Letters that stand for digits, in words made of digits and such letters alone.
_DIGIT_LETTER = re.compile(r"[0-9][OoIl]|[OoIl][0-9]")
_DIGIT_WORD = re.compile(r"(?<![A-Za-z0-9])(?=[OoIl]*[0-9])[0-9OoIl]+(?![A-Za-z0-9])")
_DOTTED_DIGITS = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,3}(?:[ \t]+dot[ \t]+[0-9]{1,3}){3}(?![A-Za-z0-9])", re.IGNORECASE)


@cache
def _plain(char: str) -> str:
    """The ASCII character that this one stands for, nothing for an invisible one, else itself."""
    if char in INVISIBLE:
        return ""
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    if char.isdecimal():
        return str(unicodedata.decimal(char))
    folded = unicodedata.normalize("NFKC", char)
    return folded if folded.isascii() and len(folded) == 1 else char


class Tape:
    """A rewritten text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the present text; a replacement's characters all come from the whole span's source."""
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += self.text[at:a], new
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Digit words of runs that stand for at least 7 digits and hold a digit word; what separates them goes."""
    edits = []
    for m in _SPELLED.finditer(text):
        if not _DIGIT_HINT.search(m[0]):
            continue
        found, times = [], 1
        for p in _SPELLED_PART.finditer(m[0]):
            word = p[0].lower()
            if word in ("double", "triple"):
                times = 2 if word == "double" else 3
                new = ""
            else:
                new = "+" if word in ("plus", "+") else DIGIT_WORDS.get(word, word if word.isdigit() else "") * times
                times = 1 if new else times
            found.append((m.start() + p.start(), m.start() + p.end(), new))
        if sum(len(x[2]) for x in found if x[2] != "+") >= 7:
            edits += found
    return edits


def _written_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for pattern in (_WRITTEN, _DOTTED_DIGITS):
        for m in pattern.finditer(text):
            edits += [(m.start() + p.start(), m.start() + p.end(), "@" if p[1] else ".") for p in _WRITTEN_PART.finditer(m[0])]
    return sorted(set(edits))


def deobfuscate(text: str) -> Tape | None:
    """The rewritten text, or None if nothing in it is disguised."""
    tape = Tape(text) if _ODD.search(text) else None
    if tape:
        tape.rewrite([(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _plain(m[0])) != m[0]])
    steps = ((_reference_edits, _REFERENCES), (_bracket_edits, _BRACKETED), (_written_edits, _DOT_HINT), (_mailbox_edits, _AT_HINT), (_letter_edits, _DIGIT_LETTER), (_spelled_edits, _SPELLED_HINT))
    for step, hint in steps:
        now = tape.text if tape else text
        if hint.search(now.casefold() if hint is _SPELLED_HINT else now) and (edits := step(now)):
            tape = tape or Tape(text)
            tape.rewrite(edits)
    return tape if tape and tape.text != text else None


def _reference_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "." if m[1] else "@") for m in _REFERENCES.finditer(text)]


def _mailbox_edits(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span("at"), "@") for m in _MAILBOX_AT.finditer(text)]


def _letter_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start() + i, m.start() + i + 1, "0" if c in "Oo" else "1") for m in _DIGIT_WORD.finditer(text) for i, c in enumerate(m[0]) if c in "OoIl"]


def _bracket_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(text)]


def find_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans and added spans of each kind, each by start."""
    base = {k: find(text) for k, find in FINDERS.items()}
    added: dict[str, list[Span]] = {k: [] for k in KINDS}
    if tape := deobfuscate(text):
        for kind, find in FINDERS.items():
            # Spans of a kind are disjoint and in order, before and after they are mapped back.
            ends, last = [e for _, e in base[kind]], 0
            for a, b in find(tape.text):
                span = tape.starts[a], tape.ends[b - 1]
                next_base = bisect_right(ends, span[0])
                if span[0] >= last and not (next_base < len(ends) and base[kind][next_base][0] < span[1]):
                    added[kind].append(span)
                    last = span[1]
    return base, added


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, disguised>>) of every whole text; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in text_list(batch.column(1)):
            base, added = find_spans(text)
            rows.append([{"kind": k, "start": a, "end": b, "disguised": odd} for odd, found in ((False, base), (True, added)) for k in KINDS for a, b in found[k]])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_rows(docs, [id_col, text_col], run, "doc_id long, spans array<struct<kind: string, start: long, `end`: long, disguised: boolean>>")


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every found span replaced by <kind>; all columns stay."""
    at = docs.columns.index(text_col)

    def masked(text: str | None) -> str | None:
        if not text:
            return text
        base, added = find_spans(text)
        out, done = [], 0
        for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in base[k] + added[k]):
            if a >= done:
                out += text[done:a], f"<{kind}>"
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches):
        for batch in slices(batches):
            yield batch.set_column(at, batch.schema.field(at), pa.array([masked(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def span_digests(found: DataFrame) -> DataFrame:
    """(doc_id, counts of plain spans, base_sha256, spans, n_disguised) from find_personal_data; column functions only."""
    plain = F.filter("spans", lambda s: ~s["disguised"])

    def of_kind(kind: str):
        return lambda s: s["kind"] == kind

    def text(spans: Column) -> Column:
        """By kind as listed, then start."""
        ordered = F.concat(*[F.array_sort(F.transform(F.filter(spans, of_kind(k)), lambda s: F.struct(s["start"], s["end"], s["kind"]))) for k in KINDS])
        return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    return found.select(
        "doc_id",
        *[F.size(F.filter(plain, of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(text(plain), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["disguised"])).cast("long").alias("n_disguised"),
    )
