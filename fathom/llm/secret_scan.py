"""Operator 10: secrets by dictionary-primed zstandard novelty.

Candidates are values that follow a sensitive name (token, accessToken, DB1_PASSWORD, ...): quoted or
blank-delimited values whole, with any symbols, and runs of at least SHORTEST key characters; and such runs
that start like a known provider's key. Of overlapping findings the longest is reported. A candidate's novelty
is its marginal compressed size: the text around it (AROUND bytes before and after) is compressed with and
without it, by zstandard primed with a dictionary. The dictionary has the names, placeholders and words of
code (CODE), and the WORDS most frequent words of the texts themselves, counted over all of them. A candidate is
also measured with its camelCase and separators undone, and the lower figure holds, so identifiers, word
lists, placeholders and repetitions cost few bytes; a random key costs nearly all of its own. What costs LEAST_BYTES or
more, and at least LEAST_SHARE of its length, is reported.

Plan: words are counted by a map with partial sums and one aggregation, of which the driver takes WORDS rows;
then a map over the text column in Arrow batches, then explode; no shuffle of texts. Runs are found on byte
arrays and names by byte search, so only candidates cost Python time.

A value ends at white space, so of a passphrase with blanks only its parts can be found. Without quotes it
ends before &name= and the like, punctuation after it is left off, and ${NAME}, name(...) and name[...] are
no values. A value shorter than SHORTEST needs two kinds of characters, and one without separator or quotes
three, as novelty can't tell a short word from a secret. Names are looked for in the BEFORE bytes before a
run, and a value is at most LONGEST bytes. All these are parameters of secrets().

Defined results: null and empty texts have no findings. A run repeated in one text is reported at each
place. A repeated row repeats its findings. Offsets are bytes of the UTF-8 text. The secret itself is not
returned, only its SHA-256 and its first four characters. doc_id may be of any type. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.ragged import byte_chunks, span_hashes, word_spans
from fathom.llm.scratch import small_batches

SHORTEST, LONGEST, AROUND, BEFORE = 12, 4096, 512, 64
#: Least marginal bytes, and least marginal bytes a character.
LEAST_BYTES, LEAST_SHARE = 6, 0.6
#: Words of the texts that the dictionary has.
WORDS = 6000
NAMES = r"tokens?|secrets?|passw(?:or)?ds?|passwd|passphrase|pwd|api[_\- ]?keys?|access[_\- ]?keys?|secret[_\- ]?keys?|private[_\- ]?keys?|auth(?:orization)?|bearer|credentials?|client[_\- ]?secret|signing[_\- ]?key|encryption[_\- ]?key|session[_\- ]?id|account[_\- ]?key"
SENSITIVE = re.compile(rf"(?i)({NAMES})[\w\-\[\]]{{0,20}}[\"'`]?\s{{0,4}}(?:(?:=>|:=|==|[=:,(]|\bis\b)\s{{0,4}})?(?:bearer\s|basic\s)?[\"'`(]{{0,2}}$".encode())
#: Every name has one of STEMS; "key" has a word of KEYED before it.
STEMS = (b"token", b"secret", b"passw", b"passphrase", b"pwd", b"key", b"auth", b"bearer", b"credential", b"session")
KEYED = re.compile(rb"(?:api|access|secret|private|signing|encryption|account)[_\- ]?$")
VALUE = re.compile(rf"(?i)({NAMES})[\w\-\[\]]{{0,20}}[\"'`]?\s{{0,4}}(?:(===?|=>|:=|[=:,(]|\bis\b)\s{{0,4}})?(bearer\s|basic\s)?\(?(?:([\"'`])((?:\\\S|(?!\4)[^\s\\])+)\4|(?<![\w\-])([^\s\"'`]\S*))".encode())
#: A value without quotes that only names another: ${NAME}, name(...), name[...].
REFERENCE = re.compile(rb"\$\{\w+\}|[A-Za-z_][A-Za-z_.]*[(\[].*[)\]]")
VARIABLE = re.compile(rb"\$\{\w+\}|\{\{\s*[\w.]+\s*\}\}")
OPENING = {b")": b"(", b"]": b"[", b"}": b"{", b">": b"<"}
NEXT = re.compile(rb"[&;,](?=[\w.\-]+[=:])|</")
PROVIDER = re.compile(rb"(?:AKIA[0-9A-Z]{12}|ASIA[0-9A-Z]{12}|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|eyJ[A-Za-z0-9_\-]{8,}\.|npm_|SG\.|hf_)")
CODE = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 1234567890 9876543210 qwertyuiop xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX 0000000000000000 ................ ************ "
    "your_api_key_here YOUR_API_KEY your-token-here <your-token> changeme change_me password123 example placeholder dummy test_token sample_secret insert_key_here REDACTED "
    "abort abstract access account action active adapter add address admin agent alias allow amount analysis anonymous append application apply archive argument array article assert assign async attach attempt attribute audio audit author authenticate authentication authority authorize available average avatar await "
    "back backend background backup balance base basic batch battery before begin binary binding bitmap block board body boolean border boundary branch bridge broadcast browser bucket buffer build builder bundle button bytes cache calculate calendar call callback camera cancel canvas capture card cart case cast catalog category certificate chain change channel character charge chart check checkbox child choice class classify clean clear click client clipboard clone close cluster code collect collection color column command comment commit common community company compare compile complete component compress compute condition config configuration configure confirm connect connection console constant constraint construct consumer contact container content context continue control controller convert cookie coordinate copy core correct count counter country create credential criteria cron currency current cursor custom customer cycle "
    "daily dashboard data database datetime debug decimal declare decode decrypt default define delay delegate delete deliver demo deploy deployment depth describe description design destination destroy detail detect device dialog dictionary difference digest dimension direct directory disable disconnect discount disk dispatch display distance distribute document domain done double download draft drag draw driver drop dropdown dump duplicate duration dynamic "
    "edge edit editor effect element email embed empty enable encode encrypt encryption endpoint engine enter entity entry enum environment equal error escape event exception exchange exclude execute executor exist exit expand expect experiment expire expiration explicit export expression extend extension external extract factory fail failure fallback false family favorite feature feedback fetch field figure file filter final finance find finish fixed flag float flow focus folder follow font footer force foreign form format forward found fraction frame framework frequency friend from front function future gallery game gateway general generate generator generic geometry get getter global graph grid group guard guest guide "
    "handle handler hardware hash head header health heap height hello help helper hidden hide hierarchy history home hook horse host hour html http hunter icon identifier identity ignore image immutable implement import include increment index info information inherit initial initialize inject inline input insert inspect install instance integer integration interface internal interval invalid inventory invoice invoke issue item iterate iterator java job join json jump just kernel key keyboard keyword kind label lambda language large last latency launch layer layout lazy leader leaf league learn left legacy length letter level library license lifecycle light limit line link list listen listener literal load loader local locale location lock log logger logic login logout long lookup loop lower "
    "machine main manage manager manifest manual map mapper margin mark market mask master match material matrix maximum measure media member memory menu merge message metadata method metric middle migration minimum minute mobile mock modal mode model modify module money monitor month mount mouse move multiple mutable mutation name namespace native navigate navigation nested network next node none normal normalize note notification notify null number object observe observer offer office offset online open operation operator optimize option optional order organization origin output overflow override owner package packet padding page paint panel parameter parent parse parser part partition partner pass password patch path pattern pause payload payment peer pending percent perform period permission persist person phone photo picture pipeline pixel plan platform player plugin point pointer policy pool popup port position post power predict preference prefix prepare present preview previous price primary print priority private process processor producer product production profile program progress project promise prompt property protocol provider proxy public publish pull purchase push python "
    "quality quantity query question queue quick quota random range rank rate rating read reader ready real receive record recover recursive redirect reduce reference reflect refresh region register registry reject relation release reload remote remove render repeat replace reply report repository request require reserve reset resize resolve resource response rest restart restore result resume retry return reverse review right role rollback root rotate round route router routine rule runner runtime safe sale sample save scale scan schedule scheduler schema scope score screen script scroll search second secret section secure security segment select selector send sender sensor sequence serial serialize series server service session setting setup shape share shell shift ship shop short show sidebar sign signal signature simple simulate single size skip sleep slice slide small snapshot social socket software solution sort source space span special specification speed split sprite stack staff stage standard staple start state statement static station statistics status step stop storage store strategy stream street strict string struct style subject submit subscribe subscription success suffix suggest sum summary super support suspend swap switch symbol sync syntax system "
    "table tag target task team template temporary tenant term terminal test text texture theme thread threshold throttle throw ticket time timeout timer timestamp title today toggle token tool toolbar tooltip topic total touch trace track traffic train transaction transfer transform transition translate transport travel tree trigger true trust tuple tutorial type unique unit universal unknown unlock unsigned update upgrade upload upper usage user username utility valid validate validator value variable vector vendor verify version vertex video view viewer virtual visible visit volume wait wallet warning watch weather web week weight widget width window wire wizard word work worker workflow workspace world wrap wrapper write writer year yield zone zoom battery correct "
    "import from return function const let var class public private static void string String int bool true false null None undefined self this new process.env os.environ getenv get_secret get_password getAccessToken getPassword "
    "access_token refresh_token id_token auth_token api_key apiKey secret_key secretKey private_key public_key client_id client_secret session_id user_name passphrase credentials authorization Authorization: Bearer Basic Content-Type application/json https://www.example.com http://localhost:8080/ "
    "token = \" secret: ' password=\" api_key: \" key => ' value connection_string database_url DATABASE_URL aws_access_key_id aws_secret_access_key "
    "the and that with this from have which their would there about other these where into could "
).encode()
FINDING = "array<struct<start: int, length: int, name: string, novelty: int, share: double, head: string, sha256: string>>"
_KEY = np.zeros(256, bool)
_KEY[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_-=.~")]] = True


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_JOINT = re.compile(rb"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\-./]+")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word and n of each chunk's words of 4 to 24 ASCII letters."""
    for batch in batches:
        for _, _, data, offsets in byte_chunks(batch.column(0)):
            starts, ends, _ = word_spans(data, offsets, _LETTER)
            keep = (ends - starts >= 4) & (ends - starts <= 24)
            starts, ends = starts[keep], ends[keep]
            _, first, n = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
            raw = data.tobytes()
            yield pa.record_batch([pa.array([raw[a:b].decode("ascii").lower() for a, b in zip(starts[first].tolist(), ends[first].tolist())], pa.string()), pa.array(n, pa.int64())], ["word", "n"])


def dictionary(docs: DataFrame, words: int = WORDS) -> bytes:
    """CODE after the texts' most frequent words, the most frequent last; at most 25 bytes a word."""
    counts = docs.select(F.col("text").cast("string").alias("text")).filter("text <> ''").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(words).collect()
    return " ".join(r["word"] for r in reversed(top)).encode() + b" " + CODE


class Novelty:
    """Marginal compressed bytes of a candidate between the texts before and after it."""

    def __init__(self, known: bytes = CODE):
        primed = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=9)
        self.compress = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def __call__(self, before: bytes, candidate: bytes, after: bytes) -> int:
        around = (before + after).replace(candidate, b"")  # a key that is used twice is no less novel
        base, plain = len(self.compress(around)), b" " + _JOINT.sub(b" ", candidate).lower()
        return min(len(self.compress(around + x)) for x in {candidate, plain}) - base


def candidates(data: np.ndarray, offsets: np.ndarray, shortest: int = SHORTEST, reach: int = BEFORE) -> Iterator[tuple[int, int, int, str]]:
    """(row, start, end, name) of the key runs in a sensitive place."""
    key = _KEY[data]
    edge = np.flatnonzero(np.diff(np.r_[False, key, False].astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    start, end = start[end - start >= shortest], end[end - start >= shortest]
    raw = data.tobytes()
    for s, e in zip(start.tolist(), end.tolist()):
        # a run may span documents, and may carry a name or separator at its front
        for row in range(int(np.searchsorted(offsets, s, "right")) - 1, int(np.searchsorted(offsets, e, "left"))):
            a, b = max(s, int(offsets[row])), min(e, int(offsets[row + 1]))
            text = raw[a:b].rstrip(b"=.-~")
            if (cut := re.match(rb"[A-Za-z_\-.][\w\-./+~=]*=", text)) and len(text) > cut.end():
                a, text = a + cut.end(), text[cut.end() :]
            if len(text) >= shortest:
                before = raw[max(int(offsets[row]), a - reach) : a]
                if found := SENSITIVE.search(before):
                    yield row, a, a + len(text), found[1].decode().lower()
                elif PROVIDER.match(text):
                    yield row, a, a + len(text), "provider"


def kinds(value: bytes) -> int:
    """Of lower case, upper case after the first character, digits and symbols, how many value has."""
    return sum(re.search(k, value) is not None for k in (rb"[a-z]", rb"(?<!^)[A-Z]", rb"[0-9]", rb"[^A-Za-z0-9]"))


def bare(value: bytes) -> bytes:
    """A value without quotes, without what follows it."""
    if end := NEXT.search(value):
        value = value[: end.start()]
    while value and (value[-1:] in b",;.\"'`" or value.count(value[-1:]) > value.count(OPENING.get(value[-1:], value[-1:]))):
        value = value[:-1]
    return value.rstrip(b"=.-~") if all(_KEY[c] for c in value) else value


def values(data: np.ndarray, offsets: np.ndarray, shortest: int = SHORTEST, longest_value: int = LONGEST) -> Iterator[tuple[int, int, int, str]]:
    """(row, start, end, name) of the values after sensitive names."""
    raw = data.tobytes()
    lower = raw.lower()
    seen = set()
    for stem in STEMS:
        h = lower.find(stem)
        while h >= 0:
            row = int(np.searchsorted(offsets, h, "right")) - 1
            low, high = int(offsets[row]), int(offsets[row + 1])
            front = KEYED.search(lower[max(low, h - 12) : h]) if stem == b"key" else None
            begin = h - len(front[0]) if front else h
            if (front or stem != b"key") and (m := VALUE.match(raw, begin, min(high, h + BEFORE + longest_value))):
                value = m[5] or bare(m[6])
                start = m.start(5) if m[5] else m.start(6)
                least = 1 if len(value) >= shortest else 2
                if not (m[2] or m[3] or m[5]):
                    least = 3
                if value and not (VARIABLE if m[5] else REFERENCE).fullmatch(value) and kinds(value) >= least and (row, start) not in seen:
                    seen.add((row, start))
                    yield row, start, start + len(value), m[1].decode().lower()
            h = lower.find(stem, h + 1)


def longest(found: list[dict]) -> list[dict]:
    """Of findings that overlap, the longest."""
    out: list[dict] = []
    for f in sorted(found, key=lambda f: (f["start"], -f["length"])):
        if not out or f["start"] >= out[-1]["start"] + out[-1]["length"]:
            out.append(f)
        elif f["length"] > out[-1]["length"]:
            out[-1] = f
    return out


def scan(novelty: Novelty, texts: pa.Array, shortest: int = SHORTEST, longest_value: int = LONGEST, around: int = AROUND, reach: int = BEFORE, least_bytes: int = LEAST_BYTES, least_share: float = LEAST_SHARE) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for i, _, data, offsets in byte_chunks(texts):
        for row, s, e, name in {c[:3]: c for c in (*values(data, offsets, shortest, longest_value), *candidates(data, offsets, shortest, reach))}.values():
            low, high = int(offsets[row]), int(offsets[row + 1])
            secret = data[s:e].tobytes()
            cost = novelty(data[max(low, s - around) : s].tobytes(), secret, data[e : min(high, e + around)].tobytes())
            if cost >= least_bytes and cost >= least_share * len(secret):
                out[i + row].append({"start": s - low, "length": e - s, "name": name, "novelty": cost, "share": round(cost / len(secret), 4), "head": secret.decode(errors="ignore")[:4], "sha256": hashlib.sha256(secret).hexdigest()})
    return [longest(found) for found in out]


def secrets(docs: DataFrame, words: int = WORDS, **options) -> DataFrame:
    """doc_id, start, length, name, novelty, share, head and sha256 of every finding; options are those of scan()."""
    small_batches(docs.sparkSession)
    known = dictionary(docs, words)

    @F.arrow_udf(FINDING)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty = Novelty(known)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("name", pa.string()), ("novelty", pa.int32()), ("share", pa.float64()), ("head", pa.string()), ("sha256", pa.string())]))
        for batch in batches:
            yield pa.array(scan(novelty, batch, **options), kind)

    found = docs.select("doc_id", F.explode(find(docs["text"].cast("string"))).alias("f"))
    return found.select("doc_id", "f.start", "f.length", "f.name", "f.novelty", "f.share", "f.head", "f.sha256")
