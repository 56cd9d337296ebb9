"""Problem 5: template residue, filler and error pages, by character n-gram models.

Natural prose: n-grams of all longer bodies of successful records, but for what the model before finds to be residue. Error notices:
the lines of all short bodies of records whose status code tells of an error, less those that natural records hold about as often.
Filler and placeholders: a fixed list of public conventions, which keeps at least a share of 1 in LEARNED + 1 beside the notices, however many
these are. Each model counts n-grams in two views of a text, its folded
characters and its shape (runs of letters and of digits as one sign each), so that a placeholder is known by its brackets
whatever name stands inside. A second round learns from all short bodies that the first finds full of residue. Every count is over the whole
table, made in the executors; no n-gram crosses from one text to the next, so the models don't depend on partitions.

A text's residue is localised by windows of the log-likelihood ratio of the models. Only n-grams that the residue model has
seen can speak for residue. A text is excluded if a window reaches LEAST, or if windows at half of it (at a text's end, at as much for each character as the smaller window needs) cover most of the text.

What an article speaks about isn't residue: what stands between quotation marks within a sentence, and what stands in the same words in
record after record of articles. Residue takes the place of a text's own words, so what stands before it differs from record to record; where
the CONTEXT bytes before it are the same in at least SPOKEN records and in a share of SPOKEN_SHARE of all records with the like, a
phrase speaks of it. Null and blank bodies are no cases; repeated ids are separate records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textcodes as tc
from tidemark.llm.checkpoints import cut, release

BITS, GRAM, SHAPE_GRAM, WINDOWS, COMMON = 20, 4, 4, (8, 24), 3e-6
WINDOW = WINDOWS[-1]
CONTEXT, OPENING, SPOKEN, SPOKEN_SHARE = 12, 5, 3, 0.03  # bytes before, characters of the residue itself, records, share of records
BLANK = "\ue000"  # stands for what is left out; no model knows it
SHORT, LONG, LEAST, COVER = 400, 500, 24.0, 0.5  # bytes, bytes, nats, share
OFTENER, SURELY, LEARNED = 4.0, 2.0, 16  # a notice's rate against that in natural records, nats; most n-grams of notices for one of the fixed lists

# fixed values: placeholder syntaxes of common template languages and editors, and filler, in natural order
PLACEHOLDERS = (
    "{{ name }}", "{{name}}", "{{ user.name }}", "{{ body | safe }}", "{{{summary}}}", "{{{name}}}", "{0}", "{1}", "{name}", "{% include 'part' %}", "{% block content %}", "{% endblock %}", "${name}", "${user.name}", "${items[0]}",
    "#{name}", "#{user.name}", "<%= name %>", "<%= user.name %>", "<%- content %>", "<?= $name ?>", "%(name)s", "%(value)d", "%s", "%d", "%1$s", "%%NAME%%", "%%first_name%%", "%NAME%", "@@NAME@@", "@@name@@", "@@IMG:1@@",
    "__NAME__", "__FIRST_NAME__", "[[name]]", "[[*content]]", "[NAME]", "[DATE]", "[insert name here]", "[insert text here]", "[your text here]", "[Your Name]", "[TODO]", "<TODO: name>", "<TODO>", "TODO: text", "[TBD]", "TK TK TK", "TKTK", "XXXX",
    "[Bitte ergänzen]", "[Name einfügen]", "[à compléter]", "[insérer le nom]", "[completar]", "[insertar nombre]", "[inserir nome]", "[a preencher]", "[вставить текст]", "[此处填写]", "[请填写]", "[ここに入力]", "〇〇〇（要差し替え）", "●●●", "[여기에 입력]",
    "[object Object]", "undefined", "null", "NaN", "NaN min read", "#REF!", "#NAME?", "*|FNAME|*", "{$name}", "{:name}", "{!name!}",
)
FILLER = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Praesent mauris fusce nec tellus sed augue semper porta. Mauris massa vestibulum lacinia arcu eget nulla. Curabitur sodales ligula in libero. Sed dignissim lacinia nunc. Pellentesque nibh aenean quam in scelerisque sem at dolor.",
    "Maecenas mattis sed convallis tristique sem proin ut ligula vel nunc egestas porttitor. Morbi lectus risus iaculis vel suscipit quis luctus non massa. Fusce ac turpis quis ligula lacinia aliquet. Vivamus vulputate laoreet felis, donec pulvinar.",
    "Nam nec ante. Sed lacinia urna non tincidunt mattis, tortor neque adipiscing diam, a cursus ipsum ante quis turpis. Nulla facilisi. Ut fringilla suspendisse potenti nunc feugiat mi a tellus consequat imperdiet. Vestibulum sapien proin quam etiam ultrices.",
    "Suspendisse in justo eu magna luctus suscipit. Sed lectus integer euismod lacus luctus magna. Quisque cursus metus vitae pharetra auctor sem massa mattis sem at interdum magna augue eget diam. Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.",
    "Erat congue ornare dictum viverra purus enim elementum blandit felis cras vitae sapien vehicula.",
    "Your title here", "Headline goes here", "Your text goes here.", "Text goes here", "Add your text here. Replace this text before publishing.", "Click here to add your own text.", "This is a placeholder text.", "text text text text text", "test test test", "asdf asdf qwer asdf jkl", "Hello world! This is your first post. Edit or delete it, then start writing!",
    "Dies ist ein Blindtext. Bitte durch echten Inhalt ersetzen.", "Hier steht die Überschrift", "Texte à venir.", "Titre de l’article", "Ceci est un texte de remplissage.", "Texto de ejemplo. Sustituya este texto.", "Título del artículo", "Texto de exemplo. Substitua este texto.", "Título do artigo",
    "Здесь будет текст.", "Заголовок статьи", "Текст-заполнитель", "标题文字", "此处添加正文内容", "这里是示例文字", "ここに見出しが入ります", "ここに本文が入ります。", "ダミーテキストです。", "여기에 제목이 들어갑니다", "여기에 본문을 입력하세요.",
)
NOTICES = (
    "404 Not Found", "403 Forbidden", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "Page not found", "The page you are looking for does not exist.", "Access denied", "Too many requests. Please try again later.", "Something went wrong. Please try again.", "The site is down for maintenance.", "Please enable JavaScript to view this page.", "JavaScript is disabled in your browser.", "You need a newer browser to use this site.", "Checking your browser before you continue.", "Please turn off your ad blocker.", "Loading…", "Session expired. Please reload.", "Fatal error: Uncaught exception", "Stack trace:",
    "Seite nicht gefunden", "Ein Fehler ist aufgetreten.", "Bitte aktivieren Sie JavaScript.", "Zugriff verweigert", "Wartungsarbeiten. Bitte versuchen Sie es später noch einmal.", "Page introuvable", "Une erreur est survenue.", "Veuillez activer JavaScript.", "Accès refusé", "Site en maintenance. Merci de réessayer plus tard.", "Página no encontrada", "Se ha producido un error.", "Active JavaScript para continuar.", "Acceso denegado", "Sitio en mantenimiento. Inténtelo más tarde.", "Página não encontrada", "Ocorreu um erro.", "Ative o JavaScript para continuar.", "Acesso negado", "Site em manutenção. Tente mais tarde.",
    "Страница не найдена", "Произошла ошибка.", "Включите JavaScript в браузере.", "Доступ запрещён", "Ведутся технические работы. Попробуйте позже.", "页面不存在或已被删除。", "系统繁忙，请稍后再试", "请启用浏览器脚本后继续访问。", "拒绝访问", "网站维护中，请稍后再来。", "ページが見つかりません", "エラーが発生しました。", "JavaScriptを有効にしてください。", "アクセスが拒否されました", "ただいまメンテナンス中です。", "페이지를 찾을 수 없습니다", "오류가 발생했습니다.", "자바스크립트를 켜 주세요.", "접근이 거부되었습니다", "점검 중입니다. 잠시 후 다시 시도해 주세요.",
)
_QUOTE = re.compile("[“„\"«「『‘]([^“”„\"«»「」『』‘’\n]{2,60})[”“\"»」』’]")
_CACHE: dict = {}


def _shapes(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a text's shape has a sign, and the sign: a for a run of letters, A for one of capitals, X for XXX and longer, x for ideographs, 0 for digits, any other sign itself."""
    cls, alone = tc.class_table()[cps], tc.ideograph_table()[cps]
    word = (cls == tc.LETTER) & ~alone
    upper = (cps >= 65) & (cps <= 90)
    kind = np.where(alone, 3, np.where(word, 1, np.where(cls == tc.DIGIT, 2, 0)))
    first = np.ones(len(cps), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
    at = np.flatnonzero(first)
    sign = np.array([0, ord("a"), ord("0"), ord("x")], np.uint32)[kind[at]]
    sign = np.where(kind[at] == 0, np.where(cls[at] == tc.SPACE, 32, cps[at]), sign)
    sizes = np.diff(np.append(at, len(cps)))
    capital = np.add.reduceat(upper, at) == sizes
    crossed = (np.add.reduceat(cps == ord("X"), at) == sizes) & (sizes >= 3)
    sign = np.where((sign == ord("a")) & capital & (sizes > 1), ord("A"), sign)
    return at, np.where(crossed, ord("X"), sign).astype(np.uint64)


def _fold(cps: np.ndarray) -> np.ndarray:
    cps = np.where((cps >= 48) & (cps <= 57), np.uint32(48), cps)
    return np.where(tc.class_table()[cps] == tc.SPACE, np.uint32(32), cps).astype(np.uint64)


def _slots(values: np.ndarray, n: int, salt: int) -> np.ndarray:
    """The slot of the n-gram that starts at each place, as if blanks followed."""
    padded = np.concatenate([values, np.full(n - 1, 32, np.uint64)])
    h = np.full(len(values), salt, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9FB21C651E98DF25) + padded[k : k + len(values)]
    return (tc.mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


def _views(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the character n-grams; places and slots of the shape n-grams. The text has a line end on both sides."""
    shown = tc.codes(text)
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    at, sign = _shapes(shown)
    return _slots(_fold(tc.codes(lowered)), GRAM, 1), at, _slots(sign, SHAPE_GRAM, 2)


class Joined:
    """Texts joined with a line end before and after each: slots of the character n-grams, places and slots of the shape n-grams, where a text's own places
    end, and which n-grams lie within one text and the line ends beside it."""

    def __init__(self, texts: list[str]):
        whole, self.starts, ends = tc.joined(texts)
        self.gram, self.at, self.shape = _views("\n" + whole)
        self.stop = np.append(np.repeat(ends + 1, ends + 1 - self.starts), len(self.gram))  # a text's places begin with the line end before it
        self.whole_gram = np.arange(len(self.gram)) + GRAM - 1 <= self.stop
        last = np.append(self.at[SHAPE_GRAM - 1 :], np.full(min(SHAPE_GRAM - 1, len(self.at)), len(self.gram)))
        self.whole_shape = last <= self.stop[self.at]
        self.whole_gram[-1] = self.whole_shape[-1] = False


class Counts:
    def __init__(self, gram: np.ndarray | None = None, shape: np.ndarray | None = None):
        self.gram = np.zeros(1 << BITS, np.int64) if gram is None else gram
        self.shape = np.zeros(1 << BITS, np.int64) if shape is None else shape

    def add(self, texts: list[str], times: int = 1) -> Counts:
        for a, b in tc.chunks(texts):
            j = Joined(texts[a:b])
            self.add_slots(j.gram[j.whole_gram], j.shape[j.whole_shape], times)
        return self

    def add_slots(self, gram: np.ndarray, shape: np.ndarray, times: int = 1) -> None:
        self.gram += times * np.bincount(gram, minlength=1 << BITS)
        self.shape += times * np.bincount(shape, minlength=1 << BITS)

    def plus(self, other: Counts, times: int = 1) -> Counts:
        return Counts(self.gram + times * other.gram, self.shape + times * other.shape)


def _ratio(for_: np.ndarray, against: np.ndarray, common: float) -> np.ndarray:
    """Log of how much likelier an n-gram is under one model; where that model hasn't seen it, it can only speak against, and
    where it is common in the other, it says little."""
    n, m = for_.sum() + 1.0, max(against.sum(), 1e5)
    ratio = np.log((for_ + 0.05) / n) - np.log((against + 0.5) / m)
    ratio = np.where(against > max(common * m, 2.5), np.minimum(ratio, 0.3), ratio)
    return np.where(for_ > 0, np.clip(ratio, -2, 6), np.where(against > 0, -0.5, 0.0)).astype(np.float32)


class Model:
    def __init__(self, natural: Counts, residue: Counts, common: float = COMMON):
        self.gram = _ratio(residue.gram, natural.gram, common)
        self.shape = np.maximum(_ratio(residue.shape, natural.shape, common), 0)

    def weights(self, text: str) -> np.ndarray:
        return self._weighed(*_views(text))

    def _weighed(self, gram: np.ndarray, at: np.ndarray, shape: np.ndarray) -> np.ndarray:
        w = self.gram[gram].copy()
        w[at] += np.where(self.shape[shape] > 1.5, 1.5 * self.shape[shape], 0)
        w[1 - GRAM :] = 0
        return w

    @staticmethod
    def _windows(w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1), np.cumsum(w, dtype=np.float64), np.zeros(WINDOW)])
        sums[len(w) + 1 :] = sums[len(w)]
        return np.max([sums[n : n + len(w)] - sums[: len(w)] for n in WINDOWS], axis=0)

    def windows(self, j: Joined) -> np.ndarray:
        """Of joined texts, the heavier window from each place as far as its text goes: what it weighs in the text alone."""
        w = self.gram[j.gram]
        w[j.at] += np.where((self.shape[j.shape] > 1.5) & j.whole_shape, 1.5 * self.shape[j.shape], 0)
        w[~j.whole_gram] = 0
        sums, at = np.concatenate([np.zeros(1), np.cumsum(w, dtype=np.float64)]), np.arange(len(w))
        return np.max([sums[np.minimum(at + n, j.stop)] for n in WINDOWS], axis=0) - sums[:-1]

    def peaks(self, texts: list[str]) -> np.ndarray:
        """The weight of each text's heaviest window."""
        out = np.zeros(len(texts))
        for a, b in tc.chunks(texts):
            j = Joined(texts[a:b])
            out[a:b] = np.maximum.reduceat(self.windows(j), j.starts)
        return out

    def suspects(self, texts: list[str]) -> list[int]:
        """Numbers of the texts that can have heavy windows."""
        least = LEAST / 2 / WINDOWS[0] * np.minimum(WINDOWS[0], np.fromiter((len(t) for t in texts), np.int64, len(texts)))
        return np.flatnonzero(self.peaks(texts) >= least).tolist() if texts else []

    def regions(self, text: str) -> tuple[list[tuple[float, int, int, int, int]], int]:
        """(heaviest window, characters without white space, where it begins, where it ends, where its own first sign stands) of each run of heavy windows, after
        what is quoted in sentences; and the characters of the text."""
        plain = _QUOTE.sub(lambda m: m[0][0] + BLANK * len(m[1]) + m[0][-1], text)
        shown = "\n" + plain + "\n"
        gram, at, shape = _views(shown)
        w = self._windows(self._weighed(gram, at, shape))
        cls = tc.class_table()[tc.codes(shown)]
        filled = np.concatenate([np.zeros(1, np.int64), np.cumsum(cls != tc.SPACE)])
        short = np.minimum(WINDOWS[0], len(shown) - np.arange(len(shown)))  # the smaller window as far as the text goes
        heavy = np.flatnonzero(w >= LEAST / 2 / WINDOWS[0] * short)
        out = []
        if len(heavy):
            for run in np.split(heavy, np.flatnonzero(np.diff(heavy) > WINDOW) + 1):
                a, b = int(run[0]), min(int(run[-1]) + WINDOW, len(shown))
                own = self.gram[gram[a:b]] >= 2
                signs = own & (cls[a:b] == tc.OTHER)
                first = a + int(np.argmax(signs if signs.any() else own))
                out.append((float(w[run].max()), int(filled[b] - filled[a]), max(a - 1, 0), min(b - 1, len(text)), max(first - 1, 0)))
        return out, int(filled[-1])

    def is_residue(self, text: str) -> bool:
        """Whether most of a text is residue."""
        runs, size = self.regions(text)
        return sum(x[1] for x in runs) >= COVER * max(size, 1)


def _sums(slots: DataFrame) -> Counts:
    """Counts of (slot, n). The table has a fixed size."""
    got = slots.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 << BITS, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return Counts(out[: 1 << BITS], out[1 << BITS :])


def _slot_rows(counts: Counts) -> pa.RecordBatch:
    both = np.concatenate([counts.gram, counts.shape])
    at = np.flatnonzero(both)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[at])], ["slot", "n"])


def _count(model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model and model.value
        counts = Counts()
        for batch in batches:
            for a, b in tc.chunks(texts := batch.column(0).to_pylist()):
                j = Joined(texts[a:b])
                kept = j.whole_gram
                if m:
                    w = m.windows(j)
                    strong = np.maximum.reduceat(w, j.starts) >= least
                    heavy = np.flatnonzero((w >= LEAST / 2) & np.append(np.repeat(strong, np.diff(np.append(j.starts, len(w) - 1))), False))
                    edges = np.bincount(heavy, minlength=len(w) + 1) - np.bincount(np.minimum(heavy + WINDOW, j.stop[heavy]), minlength=len(w) + 1)
                    kept = kept & (np.cumsum(edges)[: len(w)] == 0)
                counts.add_slots(j.gram[kept], j.shape[kept[j.at] & j.whole_shape])
        yield _slot_rows(counts)

    return run


def count_natural(texts: DataFrame, model: Model | None = None, least: float = 2 * LEAST) -> Counts:
    """n-grams of all texts of a column but for what a model finds to be residue in texts with windows of at least so much; weaker ones may be prose."""
    return _sums(texts.mapInArrow(_count(model and texts.sparkSession.sparkContext.broadcast(model), least), "slot bigint, n bigint"))


def _keyed(lines: DataFrame) -> DataFrame:
    """Adds the key of each line that isn't blank: equal for lines that are equal but for case, digits and white space around."""
    spaces = "".join(map(chr, np.flatnonzero(tc.class_table() == tc.SPACE)))
    plain = F.trim(F.regexp_replace(F.lower("line"), "\\p{Nd}+", "0"), F.lit(spaces))
    return lines.withColumn("plain", plain).filter("plain <> ''").withColumn("key", F.xxhash64("plain")).drop("plain")


def _lines(texts: DataFrame) -> DataFrame:
    return _keyed(texts.select(F.explode(F.split("t", "\n")).alias("line")))


def _weighed_lines(model):
    """Each line of texts with the heaviest window that starts in it or in the line before, and the heaviest of the line by itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model and model.value
        for batch in batches:
            for a, b in tc.chunks(texts := batch.column(0).to_pylist()):
                lines = [x for t in texts[a:b] for x in t.split("\n")]
                j = Joined(texts[a:b])
                starts = tc.joined(lines)[1]
                near = np.maximum.reduceat(m.windows(j), starts) if m else np.full(len(lines), LEAST)
                near = np.where(np.isin(starts, j.starts), near, np.maximum(near, np.roll(near, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(near), pa.array(m.peaks(lines) if m else near)], ["line", "near", "peak"])

    return run


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for batch in batches:
        lines, times = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
        for n in np.unique(times):
            counts.add(lines[times == n].tolist(), int(n))
    yield _slot_rows(counts)


def count_notices(texts: DataFrame, held: DataFrame, natural: int, model: Model | None = None) -> Counts:
    """n-grams of the lines of erroneous texts, less those that natural records hold about as often. held: (key, held) of the lines of so many
    natural records. With a model, also less the lines that neither look like residue to it nor stand beside such; what surely does is no natural record's own line."""
    shared = model and texts.sparkSession.sparkContext.broadcast(model)
    weighed = _keyed(texts.mapInArrow(_weighed_lines(shared), "line string, near double, peak double")).filter(F.col("near") > LEAST / 3)
    lines = cut(weighed.groupBy("line", "key").agg(F.count("*").alias("n"), F.max("peak").alias("peak")))
    own = F.when(F.col("peak") >= 2 * LEAST, F.lit(0.0)).otherwise(F.coalesce("held", F.lit(0)))
    n, expected = F.col("n"), own * (texts.count() / max(natural, 1))
    surely = n * F.log(n / expected) - n + expected >= SURELY
    notices = lines.groupBy("key").agg(F.sum("n").alias("n"), F.max("peak").alias("peak")).join(held, "key", "left").filter((expected == 0) | ((n >= OFTENER * expected) & surely)).select("key")
    counts = _sums(lines.join(notices, "key", "left_semi").select("line", "n").mapInArrow(_count_lines, "slot bigint, n bigint"))
    release(lines)
    return counts


def _residual(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([texts[k] for k in m.suspects(texts) if m.is_residue(texts[k])], pa.string())], ["t"])

    return run


def _fixed() -> Counts:
    seeds = [f"word {p} word" for p in PLACEHOLDERS] + [f"字{p}字" for p in PLACEHOLDERS] + list(PLACEHOLDERS) * 2
    return Counts().add(seeds, 2).add(list(FILLER), 3).add(list(NOTICES), 3)


def _with_fixed(notices: Counts) -> Counts:
    fixed = _fixed()
    return notices.plus(fixed, max(1, round(int(notices.gram.sum()) / (LEARNED * int(fixed.gram.sum())))))


def train(df: DataFrame, id_col: str, body_col: str, status_col: str, ok_col: str) -> Model:
    size, failed = F.octet_length(body_col), F.coalesce(F.col(status_col) >= 400, F.lit(False))
    rows = df.select(F.col(body_col).alias("t"), size.alias("n"), failed.alias("failed"), F.coalesce(F.col(ok_col), F.lit(False)).alias("ok")).filter(F.trim("t") != "")
    short = cut(rows.filter(F.col("n") < SHORT).select("t", "failed"))
    erroneous, other = short.filter("failed").select("t"), short.filter("not failed").select("t")
    natural = rows.filter((F.col("n") >= LONG) & ~F.col("failed") & F.col("ok")).select("t")
    records = natural.count()
    if not records:  # a table of short texts only
        natural, records = other, other.count()
    held = cut(_lines(natural).groupBy("key").agg(F.count("*").alias("held")).join(_lines(short).select("key").distinct(), "key", "left_semi"))
    # the natural records still hold residue: there, being common says nothing yet
    first = Model(count_natural(natural), _with_fixed(count_notices(erroneous, held, records)), 1.0)
    residual = other.mapInArrow(_residual(df.sparkSession.sparkContext.broadcast(first)), "t string")
    everything = cut(erroneous.union(residual))
    residue = _with_fixed(count_notices(everything, held, records, first))
    second = Model(count_natural(natural, first), residue)
    model = Model(count_natural(natural, second, 1.5 * LEAST), residue)  # what the first took for residue only for want of it in natural records comes back
    release(everything, held, short)
    return model


def _context(text: str, first: int) -> tuple[int | None, int]:
    """Hashes of the words before residue on its line together with its first signs, None where there are too few; and of its first signs alone."""
    before = text[max(0, first - CONTEXT) : first].rpartition("\n")[2].encode("utf-8", "replace")[-CONTEXT:]
    opening = text[first : first + OPENING].encode("utf-8", "replace")
    hashed = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
    return (hashed(before + b"\0" + opening) if len(before) == CONTEXT else None), hashed(opening)


_REGION = "peak double, size int, evidence string, entry bigint, opening bigint"


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in tc.chunks(texts):
                at, rows = [], []
                for k in m.suspects(texts[a:b]):
                    t = texts[a + k]
                    runs, whole = m.regions(t)
                    speaks = len(t.encode("utf-8", "replace")) >= LONG and sum(x[1] for x in runs) < COVER * whole
                    for peak, size, begin, end, first in runs:
                        entry, opening = _context(t, first)
                        at.append(a + k)
                        rows.append((peak, size, t[begin:end], entry if speaks else None, opening, whole))
                columns = list(zip(*rows)) or [[]] * 6
                types = (pa.float64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32())
                taken = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*taken, *(pa.array(list(c), t) for c, t in zip(columns, types))], ["_row", "_id", "peak", "size", "evidence", "entry", "opening", "whole"])

    return run


def find(df: DataFrame, id_col: str = "scrape_id", body_col: str = "body", status_col: str = "status_code", ok_col: str = "ok") -> DataFrame:
    """(id, peak, coverage, evidence) of each record with residue; evidence is the text of its heaviest run of windows."""
    model = df.sparkSession.sparkContext.broadcast(train(df, id_col, body_col, status_col, ok_col))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(body_col).alias("_t")).filter(F.trim("_t") != "")
    regions = cut(rows.mapInArrow(_judge(model), f"_row bigint, _id {kind}, {_REGION}, whole int"))  # only of records with something heavy
    once = regions.filter("entry is not null").groupBy("_row", "opening", "entry").agg(F.lit(1).alias("one"))
    records = regions.select("_row", "opening").distinct().groupBy("opening").agg(F.count("*").alias("with_opening"))
    spoken = once.groupBy("opening", "entry").agg(F.count("*").alias("n")).join(records, "opening").filter((F.col("n") >= SPOKEN) & (F.col("n") >= SPOKEN_SHARE * F.col("with_opening"))).select("opening", "entry")
    own = regions.join(spoken, ["opening", "entry"], "left_anti")
    heaviest = F.max(F.struct("peak", "evidence"))
    found = own.groupBy("_row").agg(F.first("_id").alias(id_col), heaviest["peak"].alias("peak"), F.least(F.sum("size") / F.max("whole"), F.lit(1.0)).alias("coverage"), heaviest["evidence"].alias("evidence")).drop("_row")
    return found.filter((F.col("peak") >= LEAST) | (F.col("coverage") >= COVER))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/scrape_meta.parquet").select("scrape_id", "body", "status_code", "ok")


def p5_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(_pages(spark, sf_dir))
    return found.select("scrape_id", F.round("peak", 3).alias("peak"), F.round("coverage", 3).alias("coverage"), "evidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(_pages(spark, sf_dir)).select("scrape_id")


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records without residue."""
    pages = _pages(spark, sf_dir)
    return pages.join(find(pages).select("scrape_id"), "scrape_id", "left_anti").select("scrape_id")
