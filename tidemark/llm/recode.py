"""Problem 6: text that was decoded in the wrong code page.

A wrong decoding is a substitution cipher: each symbol (one or more shown characters, the wrong reading of a letter's bytes) stands
for a letter. Which cipher a source (host) uses, if any, is hidden, and so is what each symbol stands for. Both are learned by
expectation-maximization against bigrams of the corpus's own languages, counted over all rows:

1. Bigrams of all fields are counted (a table of fixed size). Damaged text is in it; the M steps take it out.
2. Lines that could be damaged are those with UTF-8 sequences as some single-byte page shows them, with characters that no text
   holds, or with seldom pairs beyond ASCII. They get all readings that raise their likelihood; this only bounds the work.
3. E step: each line is as shown or under one of its source's ciphers, by likelihood times the source's prior. For single-byte
   ciphers a forward-backward pass over what each byte may stand for (its letter in any page, its letter learned for the source)
   gives expected counts of byte-to-letter pairs.
   M step: the priors of the source's ciphers, its byte-to-letter table, and the bigrams, from which expected damage is taken out.
4. A line is damaged if a cipher is likelier than the line as shown. The damaged lines teach each source's table of symbols, which
   translate() applies: symbols of several characters are first written as one private character each.

A text that quotes a few garbled signs (at most QUOTE between quotation marks) has them as its subject; signs outside of quotes decide.
Replacement characters (U+FFFD) and C1 controls outside of quotes are damage that can't be undone. Null and blank fields are no
cases; repeated ids count as one record.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textcodes as tc
from tidemark.llm.checkpoints import cut
from tidemark.llm.sitelines import site_of

BITS, BACK_OFF = 20, 5.0
LEAST_GAIN, ROUNDS, QUOTE = 6.0, 2, 16  # nats that a reading has to gain beyond the odds of its cipher; rounds of EM; signs
RARE, SPARSE, LOOSE = -12.5, -11.5, 2.6  # mean log frequency of a line's pairs, and mean log of how much likelier than by chance they are, below which readings are tried
FREQUENCY = 0.5  # weight of the letters' own frequency beside their bigrams: a swap of two alphabets keeps the structure of the bigrams
FAR, MOST_KNOWN = 20.0, 400_000  # nats; lines
CLEAN, CIPHER = 200.0, 0.01  # lines as shown that each source is taken to have beforehand; share of damaged lines before any is known
TRUST, SHARP, KEEP = 40.0, 8, 0.001  # weight of the code pages' own tables in a source's table; how sharply a page is preferred that explains more of it; least share of a letter to be kept
GROUP = 256  # lines a row of the table of groups
READ_AS = ("cp1252", "cp1251", "koi8-r", "mac-roman", "cp437", "cp850", "iso8859-15", "cp1250")
MULTI = ("gb18030", "cp932", "euc-jp", "cp949", "big5")
SINGLE = ("koi8-r", "cp1251", "cp866", "cp1252", "mac-roman", "cp850", "cp1250")
LATIN = ("cp1252", "mac-roman", "cp850", "cp1250")
OPENING, CLOSING = "“„\"«「『‘'‹（(<《〈【`", "”“\"»」』’'›）)>》〉】`"
_QUOTED = re.compile(f"[{re.escape(OPENING)}][   ]?([^{re.escape(OPENING + CLOSING)}\n]{{1,{QUOTE}}}?)[   ]?[{re.escape(CLOSING)}]")
_BEYOND_ASCII = re.compile("[^\x00-\x7f]+")
_CACHE: dict = {}


def _kept(key: tuple, make):
    if key not in _CACHE:
        _CACHE[key] = make()
    return _CACHE[key]


def _inverse(page: str) -> dict[str, int]:
    """Character -> byte of a single-byte page; bytes that the page leaves undefined read as C1 controls."""
    def make() -> dict[str, int]:
        table = {}
        for b in range(256):
            try:
                table[bytes([b]).decode(page)] = b
            except UnicodeDecodeError:
                pass
        for b in range(128, 256):
            table.setdefault(chr(b), b)
        return table

    return _kept(("inverse", page), make)


def _utf8_units(page: str) -> re.Pattern:
    """One UTF-8 sequence of two to four bytes as a single-byte page shows it."""
    def make() -> re.Pattern:
        table = _inverse(page)
        group = lambda low, high: "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"
        rest = group(0x80, 0xBF)
        return re.compile(f"{group(0xC2, 0xDF)}{rest}|{group(0xE0, 0xEF)}{rest}{{2}}|{group(0xF0, 0xF4)}{rest}{{3}}")

    return _kept(("units", page), make)


def _high_runs(page: str) -> re.Pattern:
    """Runs of characters of a single-byte page that start and end with a high one."""
    def make() -> re.Pattern:
        high = "".join(re.escape(c) for c, b in _inverse(page).items() if b >= 128)
        return re.compile(f"[{high}](?:[{high}\x20-\x7e]*[{high}\x40-\x7e])?")

    return _kept(("runs", page), make)


def _swap(shown: str, written: str) -> dict[int, str]:
    """What each high character of one single-byte page is in another."""
    def make() -> dict[int, str]:
        out = {}
        for c, b in _inverse(shown).items():
            if b >= 128:
                try:
                    out[ord(c)] = bytes([b]).decode(written)
                except UnicodeDecodeError:
                    pass
        return out

    return _kept(("swap", shown, written), make)


def _to_bytes(text: str, page: str) -> bytes | None:
    try:
        if page in MULTI:
            return text.encode(page)
        return codecs.charmap_encode(text, "strict", _kept(("map", page), lambda: {ord(c): b for c, b in _inverse(page).items()}))[0]
    except UnicodeEncodeError:
        return None


def _step(line: str, shown: str, written: str, aligned: bool) -> list[tuple[str, str]] | None:
    """The line in pieces (as shown, as written) if `shown` is how it was read, None if it can't have been. Not aligned: runs are pieces."""
    if written in SINGLE and shown not in MULTI:
        table = _swap(shown, written)
        return [(c, table.get(ord(c), c)) for c in line] if aligned else [(line, line.translate(table))]
    pieces: list[tuple[str, str]] = []
    end, changed = 0, False
    for m in (_utf8_units(shown) if written == "utf-8" and shown not in MULTI else _BEYOND_ASCII if shown in MULTI else _high_runs(shown)).finditer(line):
        raw = _to_bytes(m[0], shown)
        if raw is None or len(raw) < 2:
            continue
        out = raw.decode(written, "replace")
        if (out.count("�") * 12 > len(out) + 6) if written != "utf-8" or shown in MULTI else "�" in out:
            continue
        pieces.append((line[end : m.start()], line[end : m.start()]))
        pieces += _align(m[0], raw, shown, written) if aligned else [(m[0], out)]
        end, changed = m.end(), changed or out != m[0]
    if not changed:
        return None
    return [*pieces, (line[end:], line[end:])]


def _align(text: str, raw: bytes, shown: str, written: str) -> list[tuple[str, str]]:
    """Pieces of one run, as short as the bytes of both codes allow."""
    upto, at = {0: 0}, 0
    for k, c in enumerate(text):
        at += len(c.encode(shown)) if shown in MULTI else 1
        upto[at] = k + 1
    decoder = codecs.getincrementaldecoder(written)("replace")
    pieces, begin, out = [], 0, ""
    for k in range(len(raw)):
        out += decoder.decode(raw[k : k + 1], k == len(raw) - 1)
        if out and k + 1 in upto and not decoder.getstate()[0]:
            pieces.append((text[begin : upto[k + 1]], out))
            begin, out = upto[k + 1], ""
    if begin < len(text) or out:
        pieces.append((text[begin:], out))
    return pieces


def read(line: str, shown: str, written: str) -> str | None:
    """The line as it was written, if `shown` is how it was read; None if it can't have been."""
    pieces = _step(line, shown, written, False)
    out = None if pieces is None else "".join(b for _, b in pieces)
    return None if out == line else out


def apply(line: str, cipher: str) -> str:
    """The line under a cipher: one or more 'shown>written', the outermost first."""
    for step in cipher.split("+"):
        line = read(line, *step.split(">")) or line
    return line


def symbols(line: str, cipher: str) -> list[tuple[str, str]]:
    """The line under a cipher in pieces (symbol, letters); what doesn't change is a piece as it is."""
    pieces = [(line, line)]
    for step in cipher.split("+"):
        new = _step("".join(b for _, b in pieces), *step.split(">"), True)
        if new is None:
            continue
        merged, at, over = [], 0, 0  # over: how far the pieces before reach beyond the new ones
        before = iter([(c, c) for c in line] if len(pieces) == 1 else pieces)
        for a, b in new:
            need, taken = len(a) - over, ""
            while need > 0:
                x, y = next(before)
                taken, need = taken + x, need - len(y)
            over = -need
            if not taken and merged:
                merged[-1] = (merged[-1][0], merged[-1][1] + b)
            else:
                merged.append((taken, b))
        pieces = merged
    return pieces


class Bigrams:
    """Log-probabilities of a lower-case character after another, in a table of hashed pairs."""

    def __init__(self, counts: np.ndarray, singles: np.ndarray):
        self.pair, self.single = np.maximum(counts, 0).astype(np.float32), np.maximum(singles, 0).astype(np.float32)
        self.all = np.float32(max(float(self.single.sum()), 1.0))
        self.share = (self.single + np.float32(0.02)) / (self.all + np.float32(100))

    @staticmethod
    def slots(cps: np.ndarray) -> np.ndarray:
        return (tc.mix((cps[:-1].astype(np.uint64) << np.uint64(21)) | cps[1:]) >> np.uint64(64 - BITS)).astype(np.int64)

    @classmethod
    def count(cls, texts: list[str], counts: np.ndarray, singles: np.ndarray) -> None:
        """Adds the pairs of the texts' lines to the tables; a line that some texts of a chunk have in common counts once."""
        for a, b in tc.chunks(texts):
            lines = dict.fromkeys(x for t in texts[a:b] for x in t.split("\n"))
            cps = cls.fold(tc.codes("\n".join(["", *lines, ""])))
            counts += np.bincount(cls.slots(cps), minlength=1 << BITS)
            singles += np.bincount(cps & 0xFFFF, minlength=1 << 16)

    @staticmethod
    def fold(cps: np.ndarray) -> np.ndarray:
        """Lower case, digits alike, and all kinds of blank: they say nothing of the language."""
        def make() -> np.ndarray:
            table = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)
            table[48:58] = 48
            table[(tc.class_table() == tc.SPACE) & (table != 10)] = 32
            return table

        return _kept(("fold",), make)[cps]

    def between(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Score of each folded character `after` following `before`, of arrays that fit together."""
        slot = (tc.mix((before.astype(np.uint64) << np.uint64(21)) | after.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)
        own = self.share[after & 0xFFFF]
        return np.log((self.pair[slot] + BACK_OFF * own) / (self.single[before & 0xFFFF] + BACK_OFF) * own**FREQUENCY)

    def total(self, text: str) -> float:
        cps = self.fold(tc.codes("\n" + text + "\n"))
        return float(self.between(cps[:-1], cps[1:]).sum())


def _lost(c: np.ndarray) -> np.ndarray:
    """Characters that no clean text holds: replacement characters and C1 controls."""
    return (c == 0xFFFD) | ((c >= 0x80) & (c < 0xA0) & (c != 0x85))


def _unquoted(line: str) -> str:
    """The line with what stands between quotation marks blanked, if that is beyond ASCII."""
    return _QUOTED.sub(lambda m: m[0][0] + " " + m[0][-1] if not m[1].isascii() else m[0], line)


def doubtful(lines: list[str], model: Bigrams) -> list[tuple[int, bool]]:
    """(number, seldom) of the lines that could be damaged. Seldom: by their pairs; the others hold UTF-8 sequences or lost characters."""
    found: list[tuple[int, bool]] = []
    for a, b in tc.chunks(lines):
        whole = "\n" + "\n".join(lines[a:b]) + "\n"
        shown = tc.codes(whole)
        cps = model.fold(shown)
        high = cps > 127
        breaks = np.flatnonzero(shown == 10)
        of_line = lambda x: np.add.reduceat(x, breaks[:-1])
        pair = high[1:] | high[:-1]
        pairs = np.maximum(of_line(np.append(pair, False).astype(np.int64)), 1)
        at = np.flatnonzero(pair)
        after = cps[at + 1] & 0xFFFF
        count = model.pair[Bigrams.slots(cps)[at]]
        scores = np.zeros((2, len(cps)))
        scores[0, at] = np.log((count + np.float32(0.5)) / model.all)
        scores[1, at] = np.log((count + BACK_OFF * model.share[after]) / (model.single[cps[at] & 0xFFFF] + BACK_OFF)) - np.log(model.share[after])
        joint, bond = of_line(scores[0]) / pairs, of_line(scores[1]) / pairs
        filled = of_line(((cps != 32) & (cps != 10)).astype(np.int64))
        dense = of_line(high.astype(np.int64)) * 10 >= 3 * filled
        western = of_line((high & ((cps < 0x250) | ((cps >= 0x2500) & (cps < 0x2600)))).astype(np.int64)) * 10 >= 3 * filled
        seldom = np.where(dense, western | (joint < RARE) | (bond < LOOSE), joint < SPARSE)
        other = np.zeros(b - a, bool)
        other[np.searchsorted(breaks, np.flatnonzero(_lost(shown))) - 1] = True
        for page in READ_AS:
            other[np.searchsorted(breaks, np.fromiter((m.start() for m in _utf8_units(page).finditer(whole)), np.int64)) - 1] = True
        found += [(a + k, bool(seldom[k])) for k in np.flatnonzero(seldom | other).tolist()]
    return found


def _possible(line: str, seldom: bool) -> Iterator[tuple[str, str]]:
    """The ciphers worth a try: UTF-8 in a single-byte reading wherever its sequences stand; others in lines of seldom pairs, unless such
    sequences make up the line, for the pages that hold as many of its characters as any."""
    high = "".join(_BEYOND_ASCII.findall(line))
    signs = set(high)
    dense = len(high) * 10 >= 3 * (len(line) - line.count(" "))
    for shown in READ_AS:
        inside = sum(map(len, _utf8_units(shown).findall(line)))
        if inside:
            yield shown, "utf-8"
            seldom = seldom and not (dense and inside >= 0.9 * len(high))
    if seldom:
        held = {shown: len(signs & _inverse(shown).keys()) for shown in READ_AS}
        least = max(0.8 * len(signs), max(held.values()) - 0.02 * len(signs))
        for shown in READ_AS:
            if held[shown] >= least:
                yield from ((shown, w) for w in ((*MULTI, *SINGLE) if dense else LATIN) if w != shown)
        if dense:
            yield from ((s, w) for s in MULTI for w in ("utf-8", *MULTI) if s != w)


def readings(line: str, model: Bigrams, seldom: bool) -> dict[str, float]:
    """Gain in log-likelihood of each cipher that fits a line better. A reading in which UTF-8 sequences still stand is read again."""
    base, out, seen = model.total(line), {}, {line}
    near = lambda g: g >= 0.9 * max(out.values()) - FAR  # noqa: E731 - one so far behind the best has no share in what is expected
    front = [("", line, 0.0)]
    while front:
        after = []
        for name, text, gain in front:
            for shown, written in _possible(text, seldom and not name):
                new = read(text, shown, written)
                if new is None or new in seen:
                    continue
                seen.add(new)
                better = model.total(new) - base
                if better > gain:
                    cipher = f"{name}+{shown}>{written}".lstrip("+")
                    out[cipher] = better
                    after.append((cipher, new, better))
            if name:
                for shown in MULTI:
                    new = read(text, shown, "utf-8")
                    if new is not None and new not in seen and (better := model.total(new) - base) > gain:
                        seen.add(new)
                        out[f"{name}+{shown}>utf-8"] = better
        front = [x for x in after if x[0].endswith(">utf-8") or near(x[2])]
    return {c: g for c, g in out.items() if near(g)}


def class_of(cipher: str) -> str:
    """Single-byte ciphers of one shown page are one class, whose letters are learned; others are classes of their own."""
    shown, _, written = cipher.partition(">")
    return f"{shown}>?" if written in SINGLE and shown not in MULTI else cipher


class State:
    """What EM has learned of one source: shares of its classes of ciphers, and letters of its single-byte symbols."""

    def __init__(self, priors: list[dict] | None, letters: list[dict] | None, everywhere: dict[str, float]):
        self.everywhere = everywhere
        self.priors = {x["cipher"]: x["share"] for x in priors or []}
        self.table: dict[tuple[str, str], dict[str, float]] = defaultdict(dict)
        for x in letters or []:
            self.table[x["cipher"], x["symbol"]][x["letter"]] = x["n"]
        self.known: dict[tuple[str, str], list[tuple[str, float]]] = {}
        self.pages: dict[str, dict[str, float]] = {}

    def of_pages(self, cipher: str) -> dict[str, float]:
        """How far each page explains what a class's symbols were learned to be; a tenth is spread over all pages."""
        if cipher not in self.pages:
            shown, fits = cipher[:-2], dict.fromkeys(SINGLE, 0.0)
            whole = 0.0
            for (c, symbol), seen in self.table.items():
                if c == cipher:
                    whole += sum(seen.values())
                    for w in SINGLE:
                        fits[w] += seen.get(_swap(shown, w).get(ord(symbol)), 0.0)
            sharp = {w: (x / whole) ** SHARP if whole else 1.0 for w, x in fits.items() if w != shown}
            self.pages[cipher] = {w: 0.9 * x / max(sum(sharp.values()), 1e-12) + 0.1 / len(sharp) for w, x in sharp.items()}
        return self.pages[cipher]

    def odds(self, cipher: str) -> float:
        """Log of how much more often lines are under this class of ciphers than as shown."""
        share = self.priors.get(cipher, 0.0) + CLEAN * self.everywhere.get(cipher, 0.0)
        return float(np.log(max(share, 1e-12) / (self.priors.get("", 0.0) + CLEAN)))

    def letters(self, cipher: str, symbol: str) -> list[tuple[str, float]]:
        """(letter, log-probability) of a symbol: what its byte is in each page, by what the source has shown so far."""
        key = (cipher, symbol)
        if key not in self.known:
            shown, pages = cipher[:-2], Counter()
            for w, weight in self.of_pages(cipher).items():
                if x := _swap(shown, w).get(ord(symbol)):
                    pages[x] += weight
            n, seen = sum(pages.values()), self.table.get(key, {})
            all_ = TRUST + sum(seen.values())
            share = {x: (TRUST * pages[x] / max(n, 1e-12) + seen.get(x, 0.0)) / all_ for x in {*pages, *seen}}
            self.known[key] = [(x, float(np.log(p))) for x, p in share.items() if p >= KEEP] or [(symbol, 0.0)]
        return self.known[key]


def forward_backward(line: str, cipher: str, state: State, model: Bigrams) -> tuple[float, list[tuple[str, list[tuple[str, float]]]]]:
    """Log-likelihood of a line under a single-byte class, and for each of its symbols the probabilities of its letters."""
    inverse = _inverse(cipher[:-2])
    options = [[("\n", 0.0)], *(state.letters(cipher, c) if inverse.get(c, 0) >= 128 else [(c, 0.0)] for c in line), [("\n", 0.0)]]
    signs = [model.fold(tc.codes("".join(x for x, _ in o))) for o in options]
    given = [np.array([p for _, p in o]) for o in options]
    scores = model.between(np.concatenate([np.repeat(a, len(b)) for a, b in zip(signs, signs[1:])]), np.concatenate([np.tile(b, len(a)) for a, b in zip(signs, signs[1:])]))
    ends = np.cumsum([len(a) * len(b) for a, b in zip(signs, signs[1:])])
    steps = [x.reshape(len(a), len(b)) + p for x, a, b, p in zip(np.split(scores, ends[:-1]), signs, signs[1:], given[1:])]
    alpha, beta = [np.zeros(1)], [np.zeros(1)]
    for s in steps:
        alpha.append(np.logaddexp.reduce(alpha[-1][:, None] + s, axis=0))
    for s in reversed(steps):
        beta.append(np.logaddexp.reduce(s + beta[-1][None, :], axis=1))
    whole = float(alpha[-1][0])
    return whole, [(c, [(x, float(np.exp(a + b - whole))) for (x, _), a, b in zip(o, al, be)]) for c, o, al, be in zip(line, options[1:], alpha[1:], beta[-2::-1]) if len(o) > 1 or inverse.get(c, 0) >= 128]


def weigh(line: str, ciphers: list[str], state: State, model: Bigrams, learned: bool) -> tuple[list[tuple[str, str, float]], dict[str, list]]:
    """(class, cipher, log of its odds against the line as shown) of a line's readings, and letters of single-byte classes. Not learned: single-byte ciphers as their pages are."""
    base, out, letters = model.total(line), [], {}
    for c in ciphers:
        kind = class_of(c)
        if kind != c and learned:
            if kind not in letters:
                whole, letters[kind] = forward_backward(line, kind, state, model)
                out.append((kind, kind, whole - base + state.odds(kind)))
        else:
            out.append((kind, c, model.total(apply(line, c)) - base + state.odds(kind)))
    return out, letters


def _shares(rows: list[tuple[str, str, float]]) -> np.ndarray:
    """Probabilities of the readings; what they lack to one is that of the line as shown."""
    odds = np.minimum(np.array([x for *_, x in rows]), 600.0)
    top = max(float(odds.max()), 0.0) if len(odds) else 0.0
    e = np.exp(odds - top)
    return e / (e.sum() + np.exp(-top))


def _fields(df: DataFrame, id_col: str, url_col: str, fields: tuple[str, ...]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return df.select(F.col(id_col).alias("_id"), F.coalesce(site_of(F.col(url_col)), F.lit("")).alias("source"), F.explode(parts).alias("p")).select("_id", "source", "p.field", "p.text").filter("text <> ''")


def _table_rows(pair: np.ndarray, single: np.ndarray) -> pa.RecordBatch:
    a, b = np.flatnonzero(pair), np.flatnonzero(single)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b + (1 << BITS)]), pa.int64()), pa.array(np.concatenate([pair[a], single[b]]), pa.float64())], ["slot", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair, single = np.zeros(1 << BITS), np.zeros(1 << 16)
    for batch in batches:
        Bigrams.count(batch.column(0).to_pylist(), pair, single)
    yield _table_rows(pair, single)


def _gathered(rows: DataFrame) -> np.ndarray:
    """Sums of (slot, n): a table of fixed size, whatever the corpus."""
    got = rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << BITS) + (1 << 16))
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def count_bigrams(texts: DataFrame) -> np.ndarray:
    """Counts of pairs, then of single characters, over all texts of a column."""
    return _gathered(texts.mapInArrow(_count, "slot bigint, n double"))


def _model(counts: np.ndarray) -> Bigrams:
    return Bigrams(counts[: 1 << BITS], counts[1 << BITS :])


def _candidates(shared):
    names = ["_id", "source", "field", "line_no", "text", "ciphers", "lost", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        known: dict[str, tuple | None] = {}  # what became of the lines seen before; emptied where it grows large
        for batch in batches:
            sources, texts = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            n = Counter()
            lines = [(k, number, x) for k, t in enumerate(texts) for number, x in enumerate(t.split("\n")) if not x.isascii()]
            for s, t in zip(sources, texts):
                n[s] += t.count("\n") + 1
            if len(known) > MOST_KNOWN:
                known.clear()
            new = list({x for *_, x in lines} - known.keys())
            known.update(dict.fromkeys(new))
            for k, seldom in doubtful(new, model):
                plain = _unquoted(new[k])
                if not plain.isascii():
                    lost = bool(_lost(tc.codes(plain)).any())
                    if (found := readings(plain, model, seldom or lost)) or lost:
                        known[new[k]] = (plain, list(found), lost)
            rows = [(k, number, *known[x]) for k, number, x in lines if known[x]]
            at, number, plain, found, lost = zip(*rows) if rows else ((), (), (), (), ())
            taken = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(number, pa.int32()), pa.array(plain, pa.string()), pa.array(found, pa.list_(pa.string())), pa.array(lost, pa.bool_()), pa.nulls(len(at), pa.int64())], names)
            none = lambda t: pa.nulls(len(n), t)
            yield pa.RecordBatch.from_arrays([none(batch.column(0).type), pa.array(list(n), pa.string()), none(pa.string()), none(pa.int32()), none(pa.string()), none(pa.list_(pa.string())), none(pa.bool_()), pa.array(list(n.values()), pa.int64())], names)

    return run


def _move(shown: str, written: str, share: float, pair: np.ndarray, single: np.ndarray) -> None:
    """Takes a line as shown out of the bigrams and puts it in as written, by its share."""
    for text, sign in ((shown, -share), (written, share)):
        cps = Bigrams.fold(tc.codes("\n" + text + "\n"))
        np.add.at(pair, Bigrams.slots(cps), sign)
        np.add.at(single, cps & 0xFFFF, sign)


def _expect(shared, learned: bool, every: bool):
    """E step: expected counts by source of classes (kind 0) and of letters of symbols (1), and what the bigrams lose and gain (2).
    every: letters of all classes, not only of those whose letters are unknown."""
    names = ["kind", "source", "cipher", "symbol", "letter", "slot", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, everywhere = shared.value
        model = _model(counts)
        pair, single = np.zeros(1 << BITS), np.zeros(1 << 16)
        for batch in batches:
            sums: dict[tuple, float] = defaultdict(float)
            for group in batch.to_pylist():
                state, source = State(group["priors"], group["letters"], everywhere), group["source"]
                for x in group["lines"]:
                    rows, letters = weigh(x["text"], x["ciphers"], state, model, learned)
                    for (kind, cipher, _), share in zip(rows, _shares(rows).tolist()):
                        if share < KEEP:
                            continue  # a repeated line counts once here: it can't vouch for itself
                        sums[0, source, kind, None, None] += share
                        if kind in letters:
                            for symbol, of in letters[kind]:
                                for letter, p in of:
                                    sums[1, source, kind, symbol, letter] += share * p
                            written = x["text"].translate({ord(s): max(of, key=lambda y: y[1])[0] for s, of in letters[kind]})
                        else:
                            if kind != cipher or every:
                                for symbol, letter in symbols(x["text"], cipher):
                                    if symbol != letter or kind != cipher and symbol > "\x7f":
                                        sums[1, source, kind, symbol, letter] += share
                            written = apply(x["text"], cipher)
                        _move(x["text"], written, share, pair, single)
            keys = list(zip(*sums)) or [[]] * 5
            types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(list(k), t) for k, t in zip(keys, types)), pa.nulls(len(sums), pa.int64()), pa.array(list(sums.values()), pa.float64())], names)
        table = _table_rows(pair, single)
        none = [pa.nulls(table.num_rows, pa.string())] * 4
        yield pa.RecordBatch.from_arrays([pa.array(np.full(table.num_rows, 2), pa.int32()), *none, table.column(0), table.column(1)], names)

    return run


def _decide(shared):
    """The likeliest class of each line; rows for damaged lines only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, everywhere = shared.value
        model = _model(counts)
        for batch in batches:
            out = []
            for group in batch.to_pylist():
                state = State(group["priors"], group["letters"], everywhere)
                for x in group["lines"]:
                    rows, _ = weigh(x["text"], x["ciphers"], state, model, True)
                    kind, _, odds = max(rows, key=lambda y: y[2], default=("", "", 0.0))
                    if odds >= LEAST_GAIN or x["lost"]:
                        out.append((group["source"], x["key"], kind if odds >= LEAST_GAIN else "", odds))
            columns = list(zip(*out)) or [[]] * 4
            types = (pa.string(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["source", "key", "cipher", "odds"])

    return run


def _grouped(lines: DataFrame, by: list[str], row: list[str]) -> DataFrame:
    """One row for at most about GROUP lines of one key: a source with a third of all lines is many rows."""
    sizes = lines.groupBy(*by).agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    part = F.pmod(F.xxhash64(*row), "parts")
    return lines.join(sizes, by).withColumn("part", part).groupBy(*by, "part").agg(F.collect_list(F.struct(*row)).alias("lines")).drop("part")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line under its class, by translate() with what the source's symbols were learned to be."""
    for batch in batches:
        out = []
        for group in batch.to_pylist():
            state = State(None, group["letters"], {})
            tables: dict[str, dict] = defaultdict(dict)
            for (cipher, symbol), seen in state.table.items():
                tables[cipher][symbol] = max(seen.items(), key=lambda x: (x[1], x[0]))[0]
            for x in group["lines"]:
                line, cipher = x["line"], x["cipher"]
                if cipher.endswith(">?"):
                    inverse = _inverse(cipher[:-2])
                    line = line.translate({ord(c): max(state.letters(cipher, c), key=lambda y: y[1])[0] for c in set(line) if inverse.get(c, 0) >= 128})
                elif cipher:
                    private, letters, coded = {}, {}, []
                    for symbol, letter in symbols(line, cipher):
                        if symbol != letter:
                            sign = private.setdefault(symbol, chr(0xF0000 + len(private)))
                            letters[ord(sign)] = tables[cipher].get(symbol, letter)
                            symbol = sign
                        coded.append(symbol)
                    line = "".join(coded).translate(letters)
                out.append((x["_id"], x["field"], x["line_no"], line))
        id_type = batch.schema.field("lines").type.value_type.field("_id").type
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (id_type, pa.string(), pa.int32(), pa.string()))], ["_id", "field", "line_no", "line"])


_LETTERS = "array<struct<cipher:string,symbol:string,letter:string,n:double>>"


def _learn(df: DataFrame, id_col: str, url_col: str, fields: tuple[str, ...], rounds: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """(decided, states): the damaged lines, and what each source's ciphers and symbols were learned to be."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    texts = _fields(df, id_col, url_col, fields)
    counts = count_bigrams(texts.select("text"))
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = lambda x: spark.sparkContext.broadcast(x)  # noqa: E731 - a table of fixed size and a number for each class of ciphers
    found = cut(texts.filter(F.col("text").rlike("[^\\x00-\\x7f]")).mapInArrow(_candidates(share(counts)), f"_id {kind}, source string, field string, line_no int, text string, ciphers array<string>, lost boolean, n bigint"))
    shown = found.filter("n is not null").groupBy("source").agg(F.sum("n").cast("double").alias("share")).select("source", F.lit("").alias("cipher"), "share")
    lines = found.filter("n is null").withColumn("key", F.xxhash64("text"))
    distinct = lines.groupBy("source", "key").agg(*(F.first(c).alias(c) for c in ("text", "ciphers", "lost")))
    groups = cut(_grouped(distinct, ["source"], ["key", "text", "ciphers", "lost"]))
    total = float(shown.agg(F.sum("share").alias("n")).first()["n"] or 1.0)
    names = groups.select(F.explode("lines").alias("x")).select(F.explode("x.ciphers").alias("c")).distinct().collect()  # pairs of pages and their chains
    classes = {class_of(r["c"]) for r in names}
    everywhere = dict.fromkeys(classes, CIPHER / max(len(classes), 1))
    states = shown.groupBy("source").agg(F.collect_list(F.struct("cipher", "share")).alias("priors")).withColumn("letters", F.lit(None).cast(_LETTERS))
    for k in range(rounds):
        e_step = _expect(share((counts, everywhere)), k > 0, every and k == rounds - 1)
        rows = cut(groups.join(states, "source", "left").repartition(slots).mapInArrow(e_step, "kind int, source string, cipher string, symbol string, letter string, slot bigint, n double"))
        counts = counts + _gathered(rows.filter("kind = 2").select("slot", "n"))
        of_class = rows.filter("kind = 0").groupBy("source", "cipher").agg(F.sum("n").alias("share"))
        everywhere = dict.fromkeys(classes, 0.01 / total) | {r["cipher"]: float(r["n"]) / total for r in of_class.groupBy("cipher").agg(F.sum("share").alias("n")).collect()}
        letters = rows.filter("kind = 1").groupBy("source", "cipher", "symbol", "letter").agg(F.sum("n").alias("n")).filter(F.col("n") >= KEEP)
        tables = letters.groupBy("source").agg(F.collect_list(F.struct("cipher", "symbol", "letter", "n")).alias("letters"))
        priors = of_class.union(shown).groupBy("source").agg(F.collect_list(F.struct("cipher", "share")).alias("priors"))
        states = cut(priors.join(tables, "source", "left"))
    decided = groups.join(states, "source", "left").repartition(slots).mapInArrow(_decide(share((counts, everywhere))), "source string, key bigint, cipher string, odds double")
    damaged = lines.select("_id", "source", "field", "line_no", "key").join(decided, ["source", "key"]).drop("key")
    return damaged.dropDuplicates(["_id", "field", "line_no"]), states


def damage(df: DataFrame, id_col: str = "scrape_id", url_col: str = "resolved_url", fields: tuple[str, ...] = ("title", "body"), rounds: int = ROUNDS) -> DataFrame:
    """(id, source, field, line_no, cipher, odds): the damaged lines; cipher is the class that expectation-maximization gives each ('page>?'
    where its letters were learned), '' where only lost characters tell; odds is the log of its posterior odds against the line as shown."""
    return _learn(df, id_col, url_col, fields, rounds, False)[0].withColumnRenamed("_id", id_col)


def restore(df: DataFrame, id_col: str = "scrape_id", url_col: str = "resolved_url", fields: tuple[str, ...] = ("title", "body"), rounds: int = ROUNDS) -> DataFrame:
    """(id, field, restored, complete): each damaged field, every damaged line read by its own class; not complete where characters are lost."""
    kind = df.schema[id_col].dataType.simpleString()
    decided, states = _learn(df, id_col, url_col, fields, rounds, True)
    decided = cut(decided.select("_id", "field", "line_no", "cipher"))
    texts = _fields(df, id_col, url_col, fields).join(decided.select("_id", "field").distinct(), ["_id", "field"], "left_semi").dropDuplicates(["_id", "field"])
    lines = texts.join(decided, ["_id", "field"]).select("source", "_id", "field", "line_no", "cipher", F.get(F.split("text", "\n"), F.col("line_no")).alias("line"))
    groups = _grouped(lines, ["source"], ["_id", "field", "line_no", "cipher", "line"])
    written = groups.join(states.select("source", "letters"), "source", "left").mapInArrow(_apply, f"_id {kind}, field string, line_no int, line string")
    by_field = written.groupBy("_id", "field").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    whole = F.array_join(F.transform(F.split("text", "\n"), lambda x, k: F.coalesce(F.col("lines")[k], x)), "\n")
    restored = texts.join(by_field, ["_id", "field"]).select(F.col("_id").alias(id_col), "field", whole.alias("restored"))
    return restored.withColumn("complete", ~F.col("restored").contains("\ufffd"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/scrape_meta.parquet").select("scrape_id", "resolved_url", "title", "body")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage(_pages(spark, sf_dir)).select("scrape_id", "field").distinct()


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore(_pages(spark, sf_dir))
