"""Credentials embedded in source code and configuration: found and redacted in place.

Quoted strings and long tokens are extracted with the name they are assigned to, where there is one. Each is scored: its Shannon entropy as
a share of what random text of its alphabet and length has. The threshold follows the name: a name about secrets lowers it, one
about passwords to nothing, an unknown or missing name leaves it high, a name of hashes, ids or public keys puts it out
of reach. Hashes, identifiers, references and known placeholders are excluded by their form. Some credentials show by their own form
(prefixed keys, signed tokens, key blocks, URL passwords, authorization headers).

The source text is never shuffled: files are scanned once for lines that assign to a name about secrets or hold a long
token, and only those lines meet the literals, by (file_id, line). Redaction goes by spans, so other occurrences of the same characters stay.
Defined cases: null and empty texts hold no credential; exact duplicate rows count once; literals whose file or line is gone are judged
by their own form and entropy alone.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import lexer as L
from quarrylens.session import table

_CONFIGURATION = frozenset({"json", "jsonc", "yaml", "toml", "hcl", "xml"})

# ---------------------------------------------------------------- entropy

_ALPHABETS = [("digits", re.compile(r"^\d+$"), 10), ("hex", re.compile(r"^[0-9a-fA-F]+$"), 16), ("base64", re.compile(r"^[A-Za-z0-9+/_=-]+$"), 64), ("any", re.compile(r"^[\x21-\x7e]+$"), 94)]


def alphabet_of(s: str) -> tuple[str, int] | None:
    return next(((n, size) for n, p, size in _ALPHABETS if p.match(s)), None)


def shannon(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def expected_entropy(n: int, size: int) -> float:
    """About the entropy of n uniform draws from an alphabet: below log2(size) where n is small."""
    return math.log2(size) - min(math.log2(size) * 0.6, (size - 1) / (2 * math.log(2) * n)) if n else 0.0


def random_share(s: str) -> float:
    """Entropy as a share of what random text of this alphabet and length has; 0 where the make-up is that of words or numbers."""
    body = s.rstrip("=")
    a = alphabet_of(body)
    if a is None or len(s) < 10 or a[0] == "digits":
        return 0.0
    name, size = a
    bits = shannon(body)
    if bits < 2.6:
        return 0.0
    if name == "hex":
        if len(body) < 16 or not any(c.isdigit() for c in body) or not any(c.isalpha() for c in body):
            return 0.0
    else:
        if len({c.islower() for c in body if c.isalpha()}) < 2 and not any(c.isdigit() for c in body):
            return 0.0
        # switches between letter case, digit and sign: words have few, random text has many
        kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in body]
        if sum(x != y for x, y in zip(kinds, kinds[1:])) < len(body) / 4:
            return 0.0
    return bits / min(expected_entropy(len(body), size), math.log2(len(body)))


#: Least share of entropy, by what the name says: of a secret, and nothing known.
SHARE_NAMED, SHARE_UNNAMED, LEAST_UNNAMED = 0.8, 0.85, 20
_WORD_RUN = re.compile(r"[a-z]{4,}|[A-Z]{4,}")


def looks_random(s: str) -> bool:
    return random_share(s) >= SHARE_NAMED


def random_by_itself(s: str) -> bool:
    """Random enough to be a key whatever its name: long, of letters of both cases and digits, few of them in runs like words. Hex is left
    out: hashes, revisions and ids have that form."""
    body = s.rstrip("=")
    return len(body) >= LEAST_UNNAMED and sum(map(len, _WORD_RUN.findall(body))) < 0.4 * len(body) and any(c.isdigit() for c in body) and any(c.isupper() for c in body) and any(c.islower() for c in body) and alphabet_of(body)[0] == "base64" and random_share(s) >= SHARE_UNNAMED


# ---------------------------------------------------------------- what isn't a credential

# fixed values: forms of placeholders and of references to a secret kept elsewhere
PLACEHOLDER = re.compile(
    r"""(?ix)^(?:
      <[^<>]*> | \$\{[^}]*\} | \$\([^)]*\) | \$[A-Z_]\w* | \{\{.*\}\} | %\(\w+\)s | %[A-Z_]+% | \#\{[^}]*\} | @\w+@ | \[[A-Z _-]+\]
    | [x*.•\-_]+ | (?:your|my|the|some|insert|enter|put|add)[-_ ].* | (?:change|replace|update|fill)[-_ ]?(?:me|this|it|in)?(?:[-_ ].*)?
    | todo|tbd|fixme|none|null|nil|undefined|n/?a|empty|unset|true|false|redacted|removed|hidden|masked|secret|password|passwd|token|bearer|basic|private-key|placeholder|dummy|sample|test|example
    | (?:env|vault|op|ssm|file|secret|secrets|sm|gcp-sm|aws-sm|arn|keychain|keyring|kms|sops|ref|awssm|azurekv|doppler|infisical|k8s)(?::|://).*
    | (?:process\.env|os\.environ|os\.getenv|getenv|System\.getenv|var|local|data|module|secrets|env)[.\[(].*
    | .*[-_](?:here|placeholder|example|goes-here)
    )$"""
)
_REFERENCE_PATH = re.compile(r"^(?:~|\.{1,2})?/(?:[a-z][a-z0-9_.-]*/)+[\w.-]+$|^[A-Za-z]:\\|^[\w.-]+\.(?:pem|key|crt|cer|json|ya?ml|toml|txt|env|p12|pfx|jks)$")
# fixed values: names of harmless settings and of values that only look random
_NOT_SECRET_LAST = frozenset(
    "ref refs path file files dir field fields kind type name names label limit length size min max days day hours hour minutes seconds ttl timeout age rotation url uri endpoint host policy count index enabled required header prefix suffix format algorithm alg mode version hint prompt id ids env var reader writer".split()
)
_NOT_SECRET_ANY = frozenset("public verify authorized hash sha sha1 sha256 sha512 checksum digest integrity commit rev revision trace request run icon logo image".split())
_PASSWORD_WORDS = frozenset("password passwords passwd pwd pass pw passphrase passcode kennwort passwort contrasena contraseña clave senha motdepasse mdp пароль 密码 パスワード 비밀번호".split())
_SECRET_WORDS = frozenset("secret secrets token credential credentials apikey auth authorization cookie identity".split())
_KEY_BEFORE = frozenset("api access secret private encryption signing hmac deploy tls ssl aws master session webhook client auth service account storage app shared crypto cipher license admin root jwt ssh gpg pgp".split())

_SUBWORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")


def name_class(name: str | None) -> str | None:
    """"password" where even a plain value is one, "secret" where a random-looking value is one, "never" where none is, null
    where the name says nothing."""
    words = [w.lower() for w in _SUBWORD.findall(name or "") if not w.isdigit()]
    if not words:
        return None
    if words[-1] in _NOT_SECRET_LAST or set(words) & _NOT_SECRET_ANY:
        return "never"
    if set(words) & _PASSWORD_WORDS or "mot de passe" in " ".join(words):
        return "password"
    if set(words) & _SECRET_WORDS or any(b == "key" and (a in _KEY_BEFORE or len(words) == 1) for a, b in zip(["", *words], words)):
        return "secret"
    return None


def _decoded(s: str) -> str | None:
    if len(s) < 8 or len(s) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", s):
        return None
    try:
        d = base64.b64decode(s, validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return None
    return d if d.isprintable() or "\n" in d else None


def is_placeholder(v: str) -> bool:
    return not v.strip() or bool(PLACEHOLDER.match(v.strip())) or "${" in v or "{{" in v or "<" in v and ">" in v


def encodes_credential(v: str) -> bool:
    """Base64 of a text that shows by its own form."""
    plain = _decoded(v) if len(v) >= 16 else None
    return plain is not None and bool(by_form(plain))


_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


_NEVER_FORM = re.compile(r"^(?:sha\d+[-:]|md5[-:]|data:|ssh-|--|[./~]|\w+(?:/\w+)*\.\w{1,5}$)")


def value_is_secret(name: str | None, value: str) -> bool:
    """A quoted string or token judged by its entropy, against the threshold that its name sets."""
    kind = name_class(name)
    v = value.strip()
    if kind == "never" or len(v) < 5 or "://" in v or is_placeholder(v) or _REFERENCE_PATH.search(v) or _UUID.match(v):
        return False
    if re.search(r"\s", v):  # a phrase, by a name that speaks of phrases
        return bool(kind == "password" and re.search(r"(?i)phrase", name or "") and 3 <= len(v.split()) <= 12)
    plain = _decoded(v)
    if plain is not None and is_placeholder(plain):
        return False
    if kind == "password":
        return not v.isdigit() and not re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)+|[a-z]+/[a-z]+|utf-\d+", v)
    if not re.fullmatch(r"[A-Za-z0-9+/_.~][A-Za-z0-9+/_.~-]{11,}={0,2}", v):
        return False
    if kind is None:
        return not _NEVER_FORM.match(v) and random_by_itself(v)
    return looks_random(v) or plain is not None and len(v) >= 16


# ---------------------------------------------------------------- credentials that show by their own form

_Q = r"[^\s\"'`<>&;,\\]"
# fixed values: published forms of keys and tokens
FORMS: list[tuple[str, re.Pattern[str]]] = [
    ("private_key", re.compile(r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN ).)*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)", re.S)),
    ("jwt", re.compile(r"(?<![\w.-])(eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,})")),
    ("key_id", re.compile(r"(?<![A-Za-z0-9/+])((?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16})(?![A-Za-z0-9/+=])")),
    ("api_key", re.compile(r"(?<![\w-])(AIza[\w-]{35})(?![\w-])")),
    ("token", re.compile(r"(?<![\w-])(gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w-]{20,}|xox[abeprs]-[\w-]{10,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|dop_v1_[0-9a-f]{40,}|shpat_[0-9a-fA-F]{32}|pypi-[\w-]{32,}|sk-[A-Za-z0-9-]{32,}|ya29\.[\w-]{20,})(?![\w-])")),
    ("url_password", re.compile(r"(?i)\b[a-z][a-z0-9+.-]*://[^\s:/@\"'<>]*:([^\s/@\"'<>]+)@")),
    ("url_parameter", re.compile(rf"(?i)[?&;](?:access_token|api_?key|token|auth|secret|password|pwd|sig|client_secret)=({_Q}+)")),
    ("connection_string", re.compile(r"(?i)(?:^|[;\s\"'])(?:password|pwd)\s*=\s*([^;\"'\s<>]+)(?=;)")),
    ("connection_string", re.compile(r"(?i)(?:^|[;\s\"'])(?:server|host|hostaddr|data source|user(?: id|name)?|uid|dbname|database)\s*=\s*[^;\s=]+[;\s](?:[\w ]+=\s*[^;\s=]+[;\s])*\s*(?:password|pwd)\s*=\s*([^;\"'\s<>]+)")),
    ("authorization", re.compile(r"(?i)(?:authorization\s*[:=]\s*[\"']?\s*)(?:bearer|basic|token|digest)\s+([\w.~+/=-]{8,})")),
    ("authorization", re.compile(r"(?<![A-Za-z])(?:Bearer|Basic)\s+([\w.~+/=-]{12,})(?![\w ]*[a-z] )")),
    ("header", re.compile(rf"(?i)\bx-[\w-]*(?:key|token|auth|secret)\s*:\s*({_Q}{{6,}})")),
    ("command", re.compile(rf"(?i)(?:--(?:token|password|passwd|pass|secret|api-?key|auth|access-token|client-secret)[= ]|\bsshpass -p ?|\bmysql\b[^\n]*? -p(?=\S)|\blogin\b[^\n]*? -p )[\"']?({_Q}{{5,}})")),
    ("command", re.compile(rf"(?i)(?:\bcurl\b[^\n]*?|\bwget\b[^\n]*?)(?:-u|--user)[= ][\"']?[^\s:\"']+:({_Q}+)")),
    ("command", re.compile(rf"\b(?:export |set |env )?[A-Z][A-Z0-9_]*(?:PASSWORD|PASSWD|SECRET|TOKEN|API_KEY|ACCESS_KEY)=[\"']?({_Q}{{6,}})")),
]
_FORM_HINT = re.compile(r"PRIVATE KEY|eyJ|AKIA|ASIA|AROA|AIDA|AIza|gh[pousr]_|github_pat|glpat|xox|[srp]k_|npm_|hf_|SG\.|dop_v1|shpat|pypi-|sk-|ya29|://|=|(?i:authorization|bearer|basic|x-[\w-]*(?:key|token|auth|secret)|--(?:token|pass|secret|api|auth|client)|-p|-u |--user)")


def by_form(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of credentials that show by their own form."""
    if not _FORM_HINT.search(text):
        return []
    out: list[tuple[int, int, str]] = []
    for kind, p in FORMS:
        for m in p.finditer(text):
            s, e = m.span(1)
            v = m[1]
            if kind == "private_key" or not is_placeholder(v):
                if kind == "authorization" and not (re.search(r"[A-Z0-9]", v) and len(v) >= 10):
                    continue
                if not any(a < e and s < b for a, b, _ in out):
                    out.append((s, e, kind))
    return out


# ---------------------------------------------------------------- named values in configuration text

_PAIRS = re.compile(
    r"""(?x)
      <add\s+key="(?P<k1>[\w.-]+)"\s+value="(?P<v1>[^"]*)"
    | <(?P<k2>[A-Za-z_][\w.-]*)>(?P<v2>[^<\n]+)</(?P=k2)>
    | "(?P<k3>[\w.-]+)"\s*:\s*"(?P<v3>(?:[^"\\\n]|\\.)*)"
    | (?P<k4>[A-Za-z_][\w.-]*)[ \t]*[:=][ \t]*"(?P<v4>(?:[^"\\\n]|\\.)*)"
    | (?P<k5>[A-Za-z_][\w.-]*)[ \t]*[:=][ \t]*'(?P<v5>[^'\n]*)'
    | (?m:^)[ \t]*(?:\#[ \t]*)?(?:-[ \t]+)?(?P<k6>[A-Za-z_][\w.-]*):[ \t]+(?P<v6>[^\s"'|>&*!{\[\#][^\n\r]*?)(?=[ \t]*(?:\r?\n|$)|[ \t]\#)
    """
)


def in_configuration(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the credentials in a configuration text, commented-out ones too."""
    out = by_form(text)
    for m in _PAIRS.finditer(text):
        n = next(i for i in "123456" if m[f"k{i}"] is not None)
        s, e = m.span(f"v{n}")
        if (value_is_secret(m[f"k{n}"], m[f"v{n}"]) or encodes_credential(m[f"v{n}"])) and not any(a < e and s < b for a, b, _ in out):
            out.append((s, e, "named"))
    return sorted(out)


# ---------------------------------------------------------------- literals and their source lines

_TYPED = re.compile(r"([^\W\d][\w$]*)\s*\??\s*:\s*[^=:\"'`(){};]{1,80}=\s*[rRbBfFuU]{0,2}[\"'`]{1,3}$")
_INNER = re.compile(r"([^\W\d][\w$]*|\"[\w-]+\"|'[\w-]+')\s*(?:\[\])?\s*(?::=|:|=>|=)\s*[rRbBfFuU]{0,2}[\"'`]{1,3}$")
_CALLED = re.compile(r"\b((?:set|with|use)_?[A-Z_a-z][\w$]*)\(\s*[\"'`]$")
_LEFT = re.compile(r"(?:^|[\s(,{*&])([^\W\d][\w$]*)\s*(?:\[\])?\s*(?::[^=]*?)?(?::=|=)(?!=)")


def assigned_name(line: str, text: str) -> str | None:
    """The name that a literal in this source line is assigned to: the nearest key or keyword before it, else the left
    side of the statement."""
    head = text.split("\n", 1)[0].rstrip("\r")
    at = line.find(head) if head else -1
    while at > 0 and line[at - 1] not in "\"'`":  # a literal begins after a quote
        at = line.find(head, at + 1)
    if at < 0:
        return None
    before = line[:at]
    m = _TYPED.search(before) or _INNER.search(before) or _CALLED.search(before) or _LEFT.search(before)
    return re.sub(r"\d+$", "", m[1].strip("\"'")) if m else None


def in_literal(text: str) -> list[tuple[int, int, str]]:
    found = by_form(text)
    return found or ([(0, len(text), "encoded")] if encodes_credential(text) else [])


REDACTED = "REDACTED"


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each credential replaced by a word that is valid in any quoting; whatever is around it stays."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, _ in sorted(spans):
        out += [text[at:s], REDACTED]
        at = e
    return "".join(out) + text[at:]


# fixed values: words in a line that can make it an assignment of a secret; a superset of name_class
_LINE_HINT = r"(?i)pass|pwd|pw\d*\b|pw\s*[:=]|secret|token|credential|key|auth|cookie|identity|kennwort|contrase|clave|senha|mdp|пароль|密码|パスワード|비밀번호"


#: Long tokens, which are scored whatever their name.
_LONG_TOKEN = r"[A-Za-z0-9+/_-]{20,}"


def secret_lines(source_files: DataFrame) -> DataFrame:
    """(file_id, line, src) of source lines that may assign to a name about secrets, or hold a long token."""
    lines = F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("p", "src")
    d = source_files.filter(F.length("content") > 0).select("file_id", lines)
    named = F.col("src").rlike(_LINE_HINT) & F.col("src").rlike("[:=(]")
    return d.filter(F.col("src").rlike(r"[\"'`]") & (named | F.col("src").rlike(_LONG_TOKEN))).select("file_id", (F.col("p") + 1).alias("line"), "src")


_SPANS = "origin string, row_id long, start int, end int, secret_text string"


def _rows(kind: str, get):
    """Spans of credentials; the last argument of ``get``'s text is the row's own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = {(kind, i, s, e, text[s:e]) for i, text, *more in f.itertuples(index=False) for s, e in get(text, *more)}
            yield pd.DataFrame(sorted(rows), columns=["origin", "row_id", "start", "end", "secret_text"])

    return run


def _by_form(text: str) -> list[tuple[int, int]]:
    return [(s, e) for s, e, _ in in_literal(text)]


def _by_entropy(text: str, src: str | None) -> list[tuple[int, int]]:
    return [(0, len(text))] if not in_literal(text) and value_is_secret(assigned_name(src, text) if src else None, text) else []


def _in_text(text: str) -> list[tuple[int, int]]:
    return [(s, e) for s, e, _ in in_configuration(text)]


def credential_spans(literals: DataFrame, extracted_files: DataFrame, source_files: DataFrame) -> DataFrame:
    """(origin, row_id, start, end, secret_text) of every credential; see the module's text."""
    lit = literals.filter(F.length("text") >= 5).select("literal_id", "file_id", "text", "line").distinct()
    text = F.col("text")
    form = lit.select("literal_id", "text").filter(text.rlike(_FORM_HINT.pattern) | text.rlike(r"^[A-Za-z0-9+/]{16,}={0,2}$")).mapInPandas(_rows("literal", _by_form), _SPANS)
    alone = text.rlike(f"^{_LONG_TOKEN}={{0,2}}$")
    scored = lit.filter(~text.contains("://")).join(secret_lines(source_files), ["file_id", "line"], "left").filter(F.col("src").isNotNull() | alone)
    scored = scored.select("literal_id", "text", "src").mapInPandas(_rows("literal", _by_entropy), _SPANS)
    conf = extracted_files.filter(F.length("format_text") > 0).select("file_id", "format_text").mapInPandas(_rows("format_text", _in_text), _SPANS)
    return form.unionByName(scored).unionByName(conf)


def credentials(literals: DataFrame, extracted_files: DataFrame, source_files: DataFrame) -> DataFrame:
    """(origin, row_id, secret_text) of every credential."""
    return credential_spans(literals, extracted_files, source_files).select("origin", "row_id", "secret_text").distinct()


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("literals", "extracted_files", "source_files")]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials(*_tables(spark, sf_dir))


def _redacted(texts: pd.Series, spans: list[list[tuple[int, int, str]]]) -> dict:
    return {"n_secrets": [len(s) for s in spans], "redacted": [redact(t, s) for t, s in zip(texts, spans)]}


def p2_redacted_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, n_secrets, redacted): every configuration text with its credentials replaced."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"file_id": f["file_id"], **_redacted(f["format_text"], [in_configuration(t) for t in f["format_text"]])})

    d = table(spark, sf_dir, "extracted_files").filter(F.length("format_text") > 0).select("file_id", "format_text")
    return d.mapInPandas(run, "file_id long, n_secrets long, redacted string")


def p2_redacted_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(literal_id, redacted) of the literals that hold a credential; only its span is replaced."""
    lit = table(spark, sf_dir, "literals").select("literal_id", "text").distinct()
    found = credential_spans(*_tables(spark, sf_dir)).filter("origin = 'literal'").groupBy("row_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"literal_id": f["literal_id"], "redacted": [redact(t, [(x["start"], x["end"], "") for x in s]) for t, s in zip(f["text"], f["spans"])]})

    return lit.join(found, lit.literal_id == found.row_id).select("literal_id", "text", "spans").mapInPandas(run, "literal_id long, redacted string")


def in_source(text: str, family: str | None) -> list[tuple[int, int, str]]:
    """Spans of the credentials in a whole source file: its strings, lexed and judged by the line they stand in, and forms in
    comments; configuration files as configuration."""
    if family is None or family in _CONFIGURATION:
        return in_configuration(text)
    out: list[tuple[int, int, str]] = []
    for s, e, state, _ in L.spans(text, family)[0]:
        if state in (L.LINE, L.BLOCK):
            out += [(s + a, s + b, k) for a, b, k in by_form(text[s:e])]
            continue
        quote = 3 if state in (L.DOUBLE3, L.SINGLE3) else 1
        a, b = s + quote, max(s + quote, e - quote)
        inner = text[a:b]
        here = in_literal(inner)
        if here:
            out += [(a + x, a + y, k) for x, y, k in here]
        elif len(inner) >= 5:
            line = text[max(text.rfind("\n", 0, s), text.rfind("\r", 0, s)) + 1 : e]
            if value_is_secret(assigned_name(line, inner), inner):
                out.append((a, b, "named"))
    return out


def p2_redacted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, n_secrets, redacted): every source file that holds a credential, with each replaced inside its quotes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            spans = [in_source(t, L.FAMILY.get(L.extension(p))) for p, t in zip(f["file_path"], f["content"])]
            keep = [bool(x) for x in spans]
            yield pd.DataFrame({"file_id": f["file_id"][keep], **_redacted(f["content"][keep], [x for x in spans if x])})

    d = table(spark, sf_dir, "source_files").filter(F.length("content") > 0).select("file_id", "file_path", "content")
    return d.mapInPandas(run, "file_id long, n_secrets long, redacted string")
