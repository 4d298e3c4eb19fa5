"""Natural language inside code: comments and string literals found, their language told, and its share of each file.

Files are lexed in pieces whose lexer states compose by a parallel prefix, so files of any size split safely; stored comments and literals are
single spans and are lexed alike to find what of a raw comment is text. Each span is labelled by multinomial logistic regression on
hashed character n-grams, trained in numpy, as one of nine languages or code: only spans that it takes for a language go on. An exact
check follows, which counts the words that are left without code, tags, markup and names.

The training rows are fixed seed sentences and a bounded sample of the corpus (``SAMPLE_ROWS`` texts of at most ``SAMPLE_LONGEST`` characters, by
hash order) whose labels come from scripts, function words and forms of code; everything else covers all rows.

Defined cases: null, empty and blank texts hold no natural language; exact duplicate rows count once; a text in two
languages gets the one that fits its n-grams best; of files without a lexer nothing is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import lexer as L
from quarrylens.llm.docpairs import _CODE, _CODE_START, _LIST_NAME, _TAG, _TYPE_TAG, clean_description, name_words, split_lines
from quarrylens.llm.pieces import PIECE_CHARS, pieces_with_start
from quarrylens.llm.sampling import sampled_texts
from quarrylens.session import table

LANGUAGES = ["en", "de", "fr", "es", "pt", "ko", "ja", "zh", "ru"]
CLASSES = [*LANGUAGES, "code"]
MIN_WORDS, MIN_CJK = 4, 8
DIM = 1 << 15
SURE_CODE = 0.9
#: Texts of the corpus that the classifier may be fitted on besides the seeds, and the longest of them.
SAMPLE_ROWS, SAMPLE_LONGEST = 3000, 2000

# fixed values: seed sentences, about the words that any text of the language needs
SEEDS = {
    "en": ["the file was not found in this folder and will be read again after the next run", "you are about to remove all of the entries that have changed", "returns the first value which is not empty or null when there is none", "please wait until we have saved your work before closing this window", "this must be called once for every item, otherwise the result may be wrong", "nothing to do here because it has already been done by another process", "copyright the authors, all rights reserved, see the license file for the terms"],
    "de": ["die Datei wurde nicht gefunden und wird nach dem nächsten Lauf noch einmal gelesen", "gibt den ersten Wert zurück, der nicht leer ist, oder nichts, falls es keinen gibt", "bitte warten Sie, bis alle Änderungen gespeichert sind, bevor das Fenster geschlossen wird", "das muss für jeden Eintrag einmal aufgerufen werden, weil sonst das Ergebnis falsch ist", "löscht alle Einträge aus der Liste und meldet danach die Anzahl", "schreibt die Daten ohne Sperre auf die Platte, sobald der Puffer voll ist", "ich wuensche Ihnen schoene Gruesse und hoere gern von Ihnen", "am Abend gehen wir ueber die Bruecke zurueck nach Hause"],
    "fr": ["le fichier n'a pas été trouvé et sera relu après la prochaine exécution", "renvoie la première valeur qui n'est pas vide ou rien s'il n'y en a aucune", "veuillez attendre que toutes les modifications soient enregistrées avant de fermer la fenêtre", "cette méthode doit être appelée une fois pour chaque élément, sinon le résultat est faux", "supprime toutes les entrées de la liste et signale ensuite leur nombre", "écrit les données sans verrou sur le disque dès que le tampon est plein", "nous irons demain à la bibliothèque parce qu'il pleut depuis ce matin", "elle a acheté du pain et des pommes pour ses voisins"],
    "es": ["el fichero no se ha encontrado y se volverá a leer después de la siguiente ejecución", "devuelve el primer valor que no está vacío o nada si no hay ninguno", "espere hasta que se hayan guardado todos los cambios antes de cerrar la ventana", "este método debe llamarse una vez para cada elemento, porque si no el resultado es erróneo", "elimina todas las entradas de la lista y luego informa de cuántas hay", "escribe los datos sin bloqueo en el disco en cuanto el búfer está lleno", "mañana iremos a la biblioteca porque llueve desde esta mañana", "ella compró pan y manzanas para sus vecinos"],
    "pt": ["o arquivo não foi encontrado e será lido de novo depois da próxima execução", "devolve o primeiro valor que não está vazio ou nada se não houver nenhum", "espere até que todas as alterações sejam gravadas antes de fechar a janela", "este método deve ser chamado uma vez para cada elemento, pois senão o resultado está errado", "remove todas as entradas da lista e depois informa quantas são", "grava os dados sem trava no disco assim que o buffer estiver cheio", "amanhã vamos à biblioteca porque chove desde esta manhã", "ela comprou pão e maçãs para os seus vizinhos"],
    "ko": ["파일을 찾을 수 없어서 다음 실행 뒤에 다시 읽는다", "비어 있지 않은 첫 번째 값을 돌려주고 없으면 아무것도 돌려주지 않는다", "창을 닫기 전에 모든 변경이 저장될 때까지 기다려 주세요", "목록에서 모든 항목을 지우고 개수를 알린다"],
    "ja": ["ファイルが見つからないため次の実行の後にもう一度読み直します", "空でない最初の値を返し、なければ何も返しません", "ウィンドウを閉じる前にすべての変更が保存されるまでお待ちください", "一覧からすべての項目を削除して件数を知らせます"],
    "zh": ["没有找到文件,将在下一次运行之后重新读取", "返回第一个不为空的值,如果没有则不返回任何内容", "关闭窗口之前请等待所有更改保存完毕", "从列表中删除所有条目并报告数量"],
    "ru": ["файл не найден и будет прочитан снова после следующего запуска", "возвращает первое непустое значение или ничего, если такого нет", "подождите, пока все изменения не будут сохранены, прежде чем закрыть окно", "удаляет все записи из списка и сообщает их количество"],
    "code": ["select a, count(*) from t where x_id = ? group by b order by c limit 10", "for item in items: print(item)", "ul.menu > li:first-child a[href]", "text/plain; charset=utf-8", "server=db.example;database=main;user id=svc;password=secret;timeout=30", "curl -s -h 'x-api-key: abc' https://host.example/v1/x", "tool login --registry host.example --token abc", "if (x == null) return; call(x);", "return foo(bar, baz)", "%s:%d -> %s | %s", "insert into t (a, b) values (?, ?)", "git clone --depth 1 url && cd repo", "authorization: bearer abcdef"],
}
# fixed values: function words that tell a language in Latin script
_FUNCTION_WORDS = {
    "en": "the of and to is are was were be been has have not this that with for from by when which will may or if it they you we no in on as at once must before after".split(),
    "de": "der die das den dem des und ist sind wird werden nicht mit für fuer von zu im auf aus nach bis ohne vor weil falls sobald alle eine einen einem noch".split(),
    "fr": "le la les des du de et est sont une un dans pour par avec sans sur après avant qui que ne pas toutes tous ce soit leur dès car sauf jusqu'à".split(),
    "es": "el los las del y es son una un en para por con sin sobre después antes que no todas todos hasta cuando porque salvo desde cada cuántos hay".split(),
    "pt": "o os as do da dos das e é são uma um em no na para por com sem depois antes que não todas todos até quando pois assim cada quantos ou".split(),
}
_SHARED = {w for w in (x for v in _FUNCTION_WORDS.values() for x in v) if sum(w in v for v in _FUNCTION_WORDS.values()) > 1}

# ---------------------------------------------------------------- what of a text is natural language

_COMMAND = re.compile(r"^\s*(?:\$\s|>\s)?(?:sudo\s+)?(?:curl|wget|git|docker|kubectl|npm|npx|yarn|pip3?|python3?|node|cargo|go|make|ssh|scp|psql|mysql|redis-cli|export|cd|ls|rm|cp|mv|cat|grep|sed|tar|helm|aws|gcloud|az|terraform|tool|apt(?:-get)?|brew)\s+(?:-{1,2}\w|[\w./@:-]+(?:\s+[-./@\w]*[-/.:=@]|\s*$|\s+-))")
_SQL = re.compile(r"^\s*(?:SELECT\b.*\bFROM\b|INSERT\s+INTO\b|UPDATE\s+\S+\s+SET\b|DELETE\s+FROM\b|CREATE\s+(?:TABLE|INDEX|VIEW)\b|ALTER\s+TABLE\b|DROP\s+(?:TABLE|INDEX)\b|WITH\s+\w+\s+AS\s*\()", re.S)
_SELECTOR = re.compile(r"^\s*[.#]?[\w-]+(?:[.#:>+~\[\]=\"'()*,\s-]+[\w-]+)*\s*$")
_SNIPPET = re.compile(r"^\s*(?:for\s+\w+\s+in\s+\w+:|if\s+.+:\s*\w+|while\s+.+:|lambda\s|def\s+\w+\(|class\s+\w+[:(]|function\s*\w*\(|import\s+\w+|from\s+\w+\s+import|\w+\s*=>|const\s|let\s|var\s)|[;{}]\s*$|\w+\(\w*(?:,\s*\w+)*\)\s*[;{]")
_MARKUP = re.compile(r"</?[A-Za-z!][^<>]*>|&(?:[a-z]+|#\d+);|<[^<>\s]*>")
_HOLES = re.compile(r"\$?\{[^{}]*\}|%(?:\(\w+\))?[-+0-9.]*[sdifgxr]\b|\\[nrt0]")
_CODE_WORDS = regex.compile(
    r"""(?x) \b[a-z][a-z0-9+.-]*://\S+ | \S+@\S+\.\S+ | (?<!\w)--?[A-Za-z][\w-]*(?:=\S+)? | \S*[\\/]\S*[\\/]\S* | \S*/\S*\.\w{1,5}\b
      | \b\w+(?:\.\w+){2,}\b | \b\w*[\p{L}\d]_\w+ | \b\p{Ll}+\p{Lu}\w* | \b\w+\(\S*\) | `[^`]*` | \b0x[0-9a-fA-F]+ | \b[0-9a-fA-F]*\d[0-9a-fA-F]*\b | \b\w*\d\w*\b"""
)
_CODE_SIGN = regex.compile(r"[/@_(`\d\\:]|(?<!\w)-|\.\w|\p{Ll}\p{Lu}")
_WORD = regex.compile(r"\p{L}+(?:['’]\p{L}+)*")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_PLAIN = regex.compile(r"[\p{Ps}\p{Pi}\"'¿¡*_]*\p{L}+(?:[-'’]\p{L}+)*[\p{Pe}\p{Pf}\"'.,;:!?…*_]*")
_STUB_WORDS = frozenset("todo fixme xxx hack tbd".split())


def natural_part(text: str | None, name: str | None = None) -> str:
    """What of the text is natural language: its words without code, markup, tags and names; empty below the limits."""
    if not text or not text.strip() or text.isascii() and len(text.split(None, MIN_WORDS)) < MIN_WORDS and "\\" not in text:
        return ""
    if "\\u" in text and re.search(r"\\u[0-9a-fA-F]{4}", text):
        text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
    kept = []
    for line in split_lines(clean_description(text.replace("\\r\\n", "\n").replace("\\n", "\n").replace("\\t", " "))):
        line = line.strip()
        if not line or _TYPE_TAG.match(line) or _LIST_NAME.match(line):
            continue
        line = _TAG.sub("", line)
        if not line or _COMMAND.match(line) or _SQL.match(line) or _SNIPPET.search(line) or _CODE.match(line) or _CODE_START.match(line):
            continue
        if re.match(r"^\s*[.#][\w-]+\s*[>+~.:#\[]", line) or re.match(r"^\s*(?:[\w ]+=[^;=]*;){2,}", line):
            continue
        kept.append(line)
    t = " ".join(kept)
    # each substitution only where one of its signs stands in the text
    if "<" in t or "&" in t:
        t = _MARKUP.sub(" ", t)
    if "{" in t or "%" in t or "\\" in t:
        t = _HOLES.sub(" ", t)
    if _CODE_SIGN.search(t):
        t = _CODE_WORDS.sub(" ", t)
    if name and name in t:
        t = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", " ", t)
    words = _WORD.findall(t)
    cjk = len(_CJK.findall(t))
    if cjk >= MIN_CJK:
        return " ".join(words)
    if "-----BEGIN " in text or re.match(r"\s*(?:ssh-(?:rsa|ed25519|dss)|ecdsa-\S+) ", text):
        return ""
    # words stand between blanks: parts of patterns, ids and keys don't
    plain = [w for w in t.split() if _PLAIN.fullmatch(w) and not _CJK.search(w)]
    latin = [w for w in plain if _WORD.search(w)[0].lower() not in _STUB_WORDS]
    if len(latin) < MIN_WORDS:
        return ""
    if name:
        own = name_words(name) | {"test"}
        if all(_WORD.search(w)[0].lower() in own for w in latin):
            return ""
    return " ".join(words)


# ---------------------------------------------------------------- multinomial logistic regression on hashed n-grams

_M = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of one to four characters of all texts, start of each text's own)."""
    padded = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(p) for p in padded], np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    out, owner = [], []
    with np.errstate(over="ignore"):
        for k in range(1, 5):
            if n < k:
                break
            h = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                h = h * _M[0] + codes[j : n - k + 1 + j] * _M[j]
            same = doc[: n - k + 1] == doc[k - 1 :]
            h = ((h ^ (h >> np.uint64(33))) * _M[k - 1]) >> np.uint64(49)
            out.append(h[same].astype(np.int64))
            owner.append(doc[: n - k + 1][same])
    flat, own = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    flat = flat[order]
    counts = np.bincount(own, minlength=len(texts))
    return flat, np.concatenate([[0], np.cumsum(counts)])[:-1]


def _logits(w: np.ndarray, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    size = np.diff(np.append(start, len(flat)))
    total = np.add.reduceat(w[flat], start, axis=0)
    return total / np.sqrt(size)[:, None]


def train(texts: list[str], labels: list[int], epochs: int = 25, rate: float = 0.15, decay: float = 1e-5) -> np.ndarray:
    """Weights (DIM x classes) by full-batch Adam; classes weigh alike."""
    flat, start = features(texts)
    size = np.diff(np.append(start, len(flat)))
    y = np.eye(len(CLASSES), dtype=np.float32)[labels]
    per_class = y.sum(axis=0)
    weight = (1 / np.maximum(per_class, 1))[labels][:, None].astype(np.float32)
    weight *= 1 / weight.sum()
    w = np.zeros((DIM, len(CLASSES)), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    scale = (1 / np.sqrt(size)).astype(np.float32)
    for t in range(1, epochs + 1):
        z = _logits(w, flat, start)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g_doc = ((p - y) * weight * scale[:, None]).astype(np.float32)
        rep = np.repeat(g_doc, size, axis=0)
        g = np.stack([np.bincount(flat, weights=rep[:, c], minlength=DIM) for c in range(len(CLASSES))], axis=1).astype(np.float32) + decay * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def classify(w: np.ndarray, texts: list[str]) -> np.ndarray:
    """Class number of each text; "code" only where its probability is ``SURE_CODE`` or more. Texts must not be empty."""
    best = []
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) < 400_000):
            chars += len(texts[end])
            end += 1
        z = _logits(w, *features(texts[at:end]))
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[p[:, -1] < SURE_CODE, -1] = 0
        best.append(p.argmax(axis=1))
        at = end
    return np.concatenate(best) if best else np.zeros(0, np.int64)


def weak_label(text: str) -> int | None:
    """A label from script and function words; null where they don't tell."""
    if regex.search(r"\p{Hangul}", text):
        return LANGUAGES.index("ko")
    if regex.search(r"[\p{Hiragana}\p{Katakana}]", text):
        return LANGUAGES.index("ja")
    if regex.search(r"\p{Han}", text):
        return LANGUAGES.index("zh")
    if regex.search(r"\p{Cyrillic}", text):
        return LANGUAGES.index("ru")
    words = text.lower().split()
    score = {k: sum(w in v and w not in _SHARED for w in words) for k, v in _FUNCTION_WORDS.items()}
    top = sorted(score.values(), reverse=True)
    if top[0] >= 2 and top[0] >= top[1] + 2:
        return LANGUAGES.index(max(score, key=score.get))
    return None


def fitted(texts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights fitted on the seeds and at most ``sample_rows`` texts of the corpus, those of least hash; the spans themselves are the
    training rows, not what the exact check leaves of them."""
    rows = sampled_texts(texts, sample_rows, 12, SAMPLE_LONGEST)
    x, y = [], []
    for lang, seeds in SEEDS.items():
        for s in seeds:
            x.append(s)
            y.append(CLASSES.index(lang))
    for t in rows:
        part = natural_part(t)
        if part:
            label = weak_label(part)
            if label is not None:
                x += [span_text(t) or part, part]
                y += [label, label]
        elif " " in t.strip():
            x.append(t)
            y.append(CLASSES.index("code"))
    return train(x, y)


_RAW_COMMENT = {"/*": "js", "//": "js", "# ": "python", "#!": "python", '""': "python", "''": "python"}


def span_text(text: str) -> str:
    """A stored comment or literal as the classifier sees it: of a raw comment what the lexer finds inside its marks, of any
    other text itself, white space folded."""
    family = _RAW_COMMENT.get(text.lstrip()[:2])
    if family:
        found, _ = L.spans(text, family)
        inner = [clean_description(text[s:e]) for s, e, st, _ in found if st in (L.LINE, L.BLOCK, L.DOUBLE3, L.SINGLE3)]
        text = "\n".join(inner) or text
    return " ".join(text.replace("\\n", " ").split())


# ---------------------------------------------------------------- the operators


def label_spans(weights: np.ndarray, texts: list[str | None], names: list[str | None]) -> list[str | None]:
    """The language of each span that is natural language: the classifier takes it for a language, and the exact check
    leaves enough words, whose n-grams then tell which language it is."""
    out: list[str | None] = [None] * len(texts)
    long = [i for i, t in enumerate(texts) if t and (not t.isascii() or len(t.split(None, MIN_WORDS - 1)) >= MIN_WORDS or "\\" in t)]
    seen = [span_text(texts[i]) for i in long]
    taken = [i for i, c in zip(long, classify(weights, [s or " " for s in seen])) if CLASSES[c] != "code"]
    parts = [natural_part(texts[i], names[i]) for i in taken]
    kept = [(i, p) for i, p in zip(taken, parts) if p]
    for (i, _), c in zip(kept, classify(weights, [p for _, p in kept])):
        if CLASSES[c] != "code":
            out[i] = CLASSES[c]
    return out


def _labelled(weights, kind: str, has_name: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            names = f["name"].tolist() if has_name else [None] * len(f)
            found = label_spans(weights.value, f["text"].tolist(), names)
            yield pd.DataFrame(sorted({(kind, i, b) for i, b in zip(f["row_id"].tolist(), found) if b}), columns=["origin", "row_id", "nl_lang"])

    return run


def natural_rows(symbols: DataFrame, literals: DataFrame) -> DataFrame:
    """(origin, row_id, nl_lang) of the docstrings and literals that are natural language."""
    spark = symbols.sparkSession
    docs = symbols.filter(F.length(F.trim("docstring")) >= 8).select(F.col("symbol_id").alias("row_id"), F.col("docstring").alias("text"), "name").distinct()
    lits = literals.filter(F.length(F.trim("text")) >= 8).select(F.col("literal_id").alias("row_id"), "text").distinct()
    weights = spark.sparkContext.broadcast(fitted(symbols.select(F.col("docstring").alias("text")).unionByName(literals.select("text"))))
    schema = "origin string, row_id long, nl_lang string"
    return docs.mapInPandas(_labelled(weights, "docstring", True), schema).unionByName(lits.mapInPandas(_labelled(weights, "literal", False), schema)).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return natural_rows(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "literals"))


def _span_chars(weights, whole: bool):
    """Characters of natural language by language, of whole files or of pieces with a known start state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            owners, sizes, parts = [], [], []
            texts = f["content"] if whole else f["piece"]
            families = [L.FAMILY.get(L.extension(p)) for p in f["file_path"]] if whole else f["family"]
            starts = [L.CODE] * len(f) if whole else f["start"]
            for i, t, fam, st in zip(f["file_id"], texts, families, starts):
                if fam is None or not t:
                    continue
                run_of: list[str] = []
                found, _ = L.spans(t, fam, int(st))
                at = None
                for s, e, kind, _ in found:
                    # neighbouring line comments are one text
                    if kind == L.LINE and run_of and at is not None and not t[at:s].strip():
                        run_of.append(t[s:e])
                        at = e
                        continue
                    if run_of:
                        _add(owners, sizes, parts, i, "\n".join(run_of))
                        run_of = []
                    if kind == L.LINE:
                        run_of, at = [t[s:e]], e
                    else:
                        _add(owners, sizes, parts, i, t[s:e])
                if run_of:
                    _add(owners, sizes, parts, i, "\n".join(run_of))
            chars: dict[tuple[int, str], int] = {}
            for i, lang, n in zip(owners, label_spans(weights.value, parts, [None] * len(parts)), sizes):
                if lang:
                    chars[i, lang] = chars.get((i, lang), 0) + n
            yield pd.DataFrame([(i, c, n) for (i, c), n in chars.items()], columns=["file_id", "nl_lang", "chars"])

    return run


def _add(owners: list, sizes: list, parts: list, owner: int, text: str) -> None:
    inner = text[1:-1] if text[:1] in "\"'`" else text
    part = natural_part(inner)
    if part:  # characters are counted as words without marks, whatever piece they stand in
        owners.append(owner)
        sizes.append(len(part))
        parts.append(inner)


def language_shares(source_files: DataFrame, symbols: DataFrame, literals: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(file_id, nl_lang, chars, share): characters of natural language in comments and strings, by language, and their
    share of the file's characters. Files without any have no row."""
    spark = source_files.sparkSession
    texts = symbols.select(F.col("docstring").alias("text")).unionByName(literals.select("text"))
    weights = spark.sparkContext.broadcast(fitted(texts))
    d = source_files.select("file_id", "file_path", "content").filter(F.length("content") > 0)
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    big = (F.length("content") > piece_chars) & ext.isin(list(L.FAMILY))
    schema = "file_id long, nl_lang string, chars long"
    small = d.filter(~big).mapInPandas(_span_chars(weights, True), schema)
    large = pieces_with_start(d.filter(big), piece_chars).mapInPandas(_span_chars(weights, False), schema)
    chars = small.unionByName(large).groupBy("file_id", "nl_lang").agg(F.sum("chars").alias("chars"))
    sizes = d.select("file_id", F.length("content").alias("size"))
    return chars.join(sizes, "file_id").select("file_id", "nl_lang", "chars", F.round(F.col("chars") / F.col("size"), 6).alias("share"))


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_shares(*(table(spark, sf_dir, t) for t in ("source_files", "symbols", "literals")))
