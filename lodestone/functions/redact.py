"""Redaction of credentials as native columns: six passes in order, each one pattern (or one walk over words).

What a pass looks for is a pattern of character runs without nested repetition. One word that holds very many `://` and no blank takes time
with the square of their number; other texts take time in proportion to their length. Each pass sees what
those before it left, so a secret that two of them know is replaced once.

Cases: a null text gives a null; an empty one stays; text that is redacted already stays and counts nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands in a secret's place.
REDACTED = "<redacted>"
#: Names that mark a key as secret anywhere in it, its separators left out; and as a whole part of it.
SENSITIVE_SUBSTRINGS = ["token", "secret", "password", "passwd", "pwd", "apikey", "credential", "privatekey", "session", "cookie"]
SENSITIVE_SEGMENTS = ["auth", "oauth", "authkey", "authorization"]
#: Words after `Authorization:` that aren't the secret.
AUTH_SCHEMES = ["bearer", "basic", "token", "digest", "negotiate", "ntlm", "apikey"]
#: Prefixes of tokens, the characters that follow, and how many at least (or exactly).
SHAPES = [
    ("gh[pousr]_", "A-Za-z0-9", 20, False), ("github_pat_", "A-Za-z0-9_", 20, False), ("A[KS]IA", "A-Z0-9", 16, True), ("npm_", "A-Za-z0-9", 30, False), ("cio", "A-Za-z0-9", 28, False),
    ("xox[abprs]-", "A-Za-z0-9-", 10, False),
]

_ALNUM = "A-Za-z0-9"
_KEY = r"[A-Za-z0-9_.\-]"
_MARK = r"[A-Z ]{0,47}?PRIVATE KEY(?: BLOCK)?-----"
_BEGIN, _END = "-----BEGIN " + _MARK, "-----END " + _MARK
INVISIBLE = "\x1b(?:\\[[^@-~]*+[@-~]?)?|[\u00ad\u200b-\u200f\u2060\ufeff]"


def _any(words: list[str], between: str = "") -> str:
    return "|".join(between.join(w) for w in words)


#: Looking ahead at the start of a key: it names a secret. The header pass owns `Authorization`.
_SECRET_KEY = rf"(?!{_KEY}*authorization(?!{_KEY}))(?={_KEY}*?(?:{_any(SENSITIVE_SUBSTRINGS, '[_.-]*')}|(?<![{_ALNUM}])(?:{_any(SENSITIVE_SEGMENTS)})(?![{_ALNUM}])))"

# URLs: up to the last @ of the authority; or, where that has none, to the last @ of the word after `user:` and no digit.
_WORD = r"\s\"'<>`"
URL = rf"(?U)(?<=[{_ALNUM}]://)(?:[^{_WORD}/?#]+(?=@)|(?![^{_WORD}/?#]*@)[^{_WORD}/?#:]*:(?![0-9])[^{_WORD}]+(?=@))"

# Headers.
_CUT = r"[\s\"',;\\]"
_HEADER = rf"(?<![{_ALNUM}])authorization[\"'\\]*+ *+[:=][ \t\"'\\]*+"
_CREDENTIAL = rf"(?!{REDACTED}(?:{_CUT}|\z))[^\s\"',;\\]++"
_SCHEME = rf"(?:{_any(AUTH_SCHEMES)})(?={_CUT}|\z)"
KNOWN = rf"(?i)({_HEADER}{_SCHEME} *+){_CREDENTIAL}"
OTHER_TWO = rf"(?i)({_HEADER})(?!{_SCHEME}){_CREDENTIAL}( ++){_CREDENTIAL}"
OTHER_ONE = rf"(?i)({_HEADER})(?!{_SCHEME}){_CREDENTIAL}"
_RUN = rf"[{_ALNUM}._~+/=\-]"
ALONE = rf"(?i)(?<![{_ALNUM}])((?:bearer|basic) ++)(?={_RUN}{{32}}|(?={_RUN}*[0-9]){_RUN}{{16}}){_RUN}++"

# Values after a key. A value in quotes runs to its closing quote, another to white space but for punctuation at its end.
_ENDS = r"[,;)\]}.]*(?:\s|\z)"
_SOME = rf"(?=[\"'\\]*[^\s\"'\\])(?![\"'\\]*{REDACTED}[\"'\\]*{_ENDS})"
_QUOTED = rf"\\*+(?:\"(?=['\\]*[^\"'\\])(?!['\\]*{REDACTED}['\\]*(?:\"|\z))[^\"]*+(?:\"|\z)|'(?=[\"\\]*[^\"'\\])(?![\"\\]*{REDACTED}[\"\\]*(?:'|\z))[^']*+(?:'|\z))"
_PLAIN = rf"{_SOME}(?![\"'])\S*[^\s,;)\]}}.]"
# what a compiler or a path says after a colon: line and column behind a name with a dot, code in backquotes, one character
_NUMBERS = r"[0-9]+(?::[0-9]+)*+"
_LEFT = lambda place, said: rf"(?<!{_KEY})(?i:{_SECRET_KEY})(?!{_KEY}*\.{_KEY}*[\"'\\]* *:[ \t]*{place})({_KEY}++[\"'\\]*+ *+(?:=[ \t]*+|:(?!:)[ \t]*+{said})"
KEYED_QUOTED = _LEFT(rf"\\*[\"'][\"'\\]*{_NUMBERS}[\"'\\]*[\"']", r"(?!\\*[\"'][\"'\\]*(?:`|[^\"'\\][\"'\\]*[\"']))") + rf"){_QUOTED}"
KEYED_PLAIN = _LEFT(rf"\\*(?![\"']){_NUMBERS}[\"'\\]*{_ENDS}", rf"(?!\\*(?:`|[^\s\"'\\][\"'\\]*{_ENDS}))") + rf"\\*+){_PLAIN}"

TOKENS = rf"(?<![{_ALNUM}])(?:" + "|".join(rf"{p}[{c}]{{{n}}}(?![{_ALNUM}])" if fixed else rf"{p}[{c}]{{{n},}}+" for p, c, n, fixed in SHAPES) + ")"

_KEY_WORD = rf"(?i)^[\"':=,]*+{_SECRET_KEY}{_KEY}++[\"':=,]*+$"
_LONG_WORD = r"^(?=[^0-9]*[0-9]|(?=[^A-Z]*[A-Z])[^a-z]*[a-z])[A-Za-z0-9+/=_.\-]{32,}$"


def visible(text: Column) -> Column:
    """Without escape sequences of terminals and characters that show nothing: they would split a secret in two."""
    return F.regexp_replace(text, INVISIBLE, "")


def _spaced(text: Column) -> Column:
    """Words and the white space between them, a long mixed word after a secret key replaced."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\s+|\S+"), F.lit(0))
    before = lambda w, i: F.coalesce(F.get(w, i - 2), F.lit(""))
    return F.transform(words, lambda x, i: F.struct(x.alias("word"), (x.rlike(_LONG_WORD) & before(words, i).rlike(_KEY_WORD)).alias("secret")))


def redacted(text: Column) -> Column:
    """struct(text, count): every credential that the passes know replaced, and how many replacements were made.

    In order: blocks of private keys (from the start, where only their end is there); user names and passwords in URLs; credentials in
    and beside `Authorization` headers; values of secret keys; long mixed words that follow a secret key; and tokens of known shapes."""
    r = REDACTED.replace("$", r"\$")
    start = F.struct(visible(text).alias("text"), F.lit(0).alias("count"))

    def replaced(pattern: str, by: str, weight: int = 1):
        return lambda s: F.struct(F.regexp_replace(s["text"], pattern, by).alias("text"), (s["count"] + weight * F.regexp_count(s["text"], F.lit(pattern))).alias("count"))

    def cut_off(s: Column) -> Column:
        begin, end = F.regexp_instr(s["text"], F.lit(_BEGIN)), F.regexp_instr(s["text"], F.lit(_END))
        hit = (end > 0) & ((begin == 0) | (end < begin))
        body = F.regexp_replace(s["text"], r"\A[\s\S]*?" + _END, r)
        return F.struct(F.when(hit, body).otherwise(s["text"]).alias("text"), (s["count"] + hit.cast("int")).alias("count"))

    def spaced(s: Column) -> Column:
        # only texts with a key get an array of their words
        words = F.when(s["text"].rlike(rf"(?<!{_KEY})(?i:{_SECRET_KEY})"), _spaced(s["text"]))
        text_of = F.array_join(F.transform(words, lambda w: F.when(w["secret"], F.lit(REDACTED)).otherwise(w["word"])), "")
        return F.struct(F.coalesce(text_of, s["text"]).alias("text"), (s["count"] + F.coalesce(F.size(F.filter(words, lambda w: w["secret"])), F.lit(0))).alias("count"))

    passes = [
        cut_off,
        replaced(rf"{_BEGIN}[\s\S]*?(?:{_END}|\z)", r),
        replaced(URL, r),
        replaced(KNOWN, "$1" + r), replaced(OTHER_TWO, "$1" + r + "$2" + r, 2), replaced(OTHER_ONE, "$1" + r), replaced(ALONE, "$1" + r),
        replaced(f"{KEYED_QUOTED}|{KEYED_PLAIN}", "$1$2" + r),  # one of the two groups is there
        spaced,
        replaced(TOKENS, r),
    ]
    # each pass names what the last one made, or every pass would be written out within the next ones again
    step = lambda s, f: F.element_at(F.transform(F.array(s), f), 1)
    return F.when(text.isNotNull(), reduce(step, passes, start))


def quoted_values(text: Column, key: str) -> Column:
    """struct(text, count): every value in double quotes after `key = `, in the case given and whatever the value is, replaced; the rest of
    the text stays as it was, other credentials too. One pass, without those of redacted()."""
    pattern = rf'({key} = )"[^"]*"'
    return F.when(text.isNotNull(), F.struct(F.regexp_replace(text, pattern, "$1" + REDACTED).alias("text"), F.regexp_count(text, F.lit(pattern)).alias("count")))
