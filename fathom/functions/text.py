"""Text functions as column expressions: folding, tokens, query expansion, follow-up detection.

Everything stays in Catalyst. fold() equals NFKD, dropping combining marks and casefolding for every code
point but Hangul syllables, which stay composed (they never reach a token).
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = frozenset(
    "while without would you your the this to use what when with is it later may might need not of on or should "
    "a after an and are as at be by can could do during for from how i if in "
    "un una y si que por para los las la es en el del de con como al".split()
)
_ALIASES = """
battery: bateria batteries percent; bleeding: hemorragia sangrado; burns: quemadura quemaduras burned burnt; cooking: stove camping
dehydration: weak urinating sed confused; lighting: linterna light; medication: medicines medicine; rescue signaling: rescate
signaling: senales senal; storage: treated store containers container; cold: frio; communications: comunicacion; compass: brujula
emergency: emergencia; fire: incendio; generator: generador; heat: calor; lost: perdido; phone: telefono; radio: radio
shelter: refugio; water: agua; wounds: cut
"""
#: Query token -> the tokens that it also searches for.
ALIASES = {word: goal.split() for part in _ALIASES.replace("\n", ";").split(";") if ":" in part for goal, words in [part.split(":")] for word in words.split()}
FOLLOW_UP_STARTS = ("also ", "and ", "can i", "how about", "next ", "should i", "then ", "what about", "what if", "what should")
FOLLOW_UP_WORDS = frozenset("night now then this that there inside outside indoors again before after with without".split())
#: White space as Python sees it.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def fold_text(text: str) -> str:
    """The same on the driver, for single strings."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


@cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters to replace one by one or drop, their replacements, and those that become several."""
    source, target, dropped, several = [], [], [], {}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        char = chr(code)
        folded = fold_text(char)
        if folded == char:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif folded:
            several[char] = folded
        else:
            dropped.append(char)
    return "".join(source + dropped), "".join(target), several


def fold(text: Column) -> Column:
    """Compatibility-decomposed, without accents, casefolded."""
    source, target, several = _tables()
    # One literal, which the optimizer turns into a map once; literals one by one would take seconds to send.
    goals = F.str_to_map(F.lit("\x02".join(f"{c}\x01{goal}" for c, goal in several.items())), F.lit("\x02"), F.lit("\x01"))
    # Which of a text's distinct non-ASCII characters need more than one; the regex stays a single range.
    foreign = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7f]"), F.lit(0)))
    wide = F.array_intersect(foreign, F.map_keys(goals))
    opened = F.aggregate(wide, text, lambda t, c: F.replace(t, c, goals[c]))
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(opened, source, target)).otherwise(F.lower(text))


def casefold(text: Column) -> Column:
    """Casefolding without accent stripping: lower case, and sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    """All runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0))


def telling(word: Column) -> Column:
    """Whether a word is longer than one character and no stopword."""
    return (F.length(word) > 1) & ~word.isin(*sorted(STOPWORDS))


def tokens(text: Column, keep_stopwords: bool = False) -> Column:
    """Tokens in their order, repeated ones too; null text has none."""
    found = F.coalesce(words(text), F.array().cast("array<string>"))
    return found if keep_stopwords else F.filter(found, telling)


def singular(token: Column) -> Column:
    """The token without a plural ending, or null."""
    size = F.length(token)
    return F.when((size > 4) & token.endswith("es"), F.left(token, size - 2)).when((size > 3) & token.endswith("s"), F.left(token, size - 1))


def expand(found: Column) -> Column:
    """Each token, its singular and its aliases, each once, in order of first appearance."""
    goals = F.str_to_map(F.lit(";".join(f"{k}:{' '.join(v)}" for k, v in ALIASES.items())), F.lit(";"), F.lit(":"))
    more = lambda t: F.concat_ws(" ", t, singular(t), goals[t])  # noqa: E731 - tokens hold no blanks, and nulls are left out
    return F.array_distinct(F.flatten(F.transform(found, lambda t: F.split(more(t), " "))))


def is_follow_up(query: Column) -> Column:
    """Whether a turn leans on the one before it."""
    said = F.regexp_replace(casefold(query), f"^[{SPACE}]+|[{SPACE}]+$", "")
    spoken = F.filter(F.split(F.replace(said, F.lit("?"), F.lit("")), f"[{SPACE}]+"), lambda w: w != "")
    starts = F.lit(False)
    for start in FOLLOW_UP_STARTS:
        starts = starts | said.startswith(start)
    short = (F.size(spoken) <= 4) & (said.endswith("?") | F.arrays_overlap(spoken, F.array(*map(F.lit, sorted(FOLLOW_UP_WORDS)))))
    return F.coalesce((said != "") & (starts | short), F.lit(False))


def title_case(text: Column) -> Column:
    """Upper case after every character that isn't a letter, lower case elsewhere."""
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1 << 30)))), "")


def shown_tags(tags: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(tags, ", "), F.lit("")), F.lit("none"))


def escape_html(text: Column) -> Column:
    """Text that may stand in HTML, also within quotes."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def url_parameter(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded and trimmed; '' where there is none or it can't be decoded."""
    said = F.regexp_extract(F.regexp_replace(url, "(?s)#.*$", ""), rf"\?(?:[^&]*&)*?{name}=([^&]*)", 1)
    return F.coalesce(F.trim(F.try_url_decode(said)), F.lit(""))
