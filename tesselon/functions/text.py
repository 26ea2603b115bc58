"""Column builders for code-aware text: tokens, queries, estimates, truncation, paths. Catalyst expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are never indexed (language keywords, then words of questions).
STOPWORDS = tuple(
    """abstract any as async await boolean break case catch class const constructor continue declare default delete
    do else enum export exports extends false finally for from function get if implements import in infer instanceof
    interface is keyof let module namespace never new null number object of private protected public readonly require
    return set static string super switch symbol this throw true try type typeof undefined unknown var void while yield
    the a an and or how does what where when why work works with to into""".split()
)

# Token patterns.
WORD = r"[A-Za-z_$][A-Za-z0-9_$]*|\d+"
PART = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"
IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$.]*$"
CHARS_PER_TOKEN = 3.6
TRUNCATION_MARK = "\n/* … shortened … */"


def _is_term(low: Column) -> Column:
    return (F.length(low) >= 2) & ~low.rlike(r"^\d+$") & ~low.isin(*STOPWORDS)


def split_identifier(word: Column) -> Column:
    """parseHTMLResponse -> [parse, HTML, Response]; separators never match, so they fall away."""
    return F.regexp_extract_all(word, F.lit(PART), F.lit(0))


def words(text: Column) -> Column:
    """Identifiers of a text; runs of digits are no terms, and what follows them is an identifier of its own."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))


def _is_plain(w: Column, low: Column) -> Column:
    """Whether a word is one part, told without a search: no separator, no capital after the first letter, no digit after a
    capital. For most words, in small letters, that is two looks for a byte."""
    rest = F.substring(w, 2, 1_000_000)
    return ~w.contains("_") & ~w.contains("$") & ((w == low) | ((F.substring(w, 2, 1) > "9") & (rest == F.lower(rest))))


def _compound_terms(w: Column, low: Column) -> Column:
    """Terms of an identifier that is not plain and no stopword."""
    none = F.array().cast("array<string>")
    single = F.when(F.length(low) >= 2, F.array(low)).otherwise(none)
    whole = F.when((F.length(low) >= 2) & (F.length(low) <= 48), F.array(low)).otherwise(none)
    parts = F.filter(F.transform(split_identifier(w), F.lower), _is_term)
    return F.when(F.size(split_identifier(w)) > 1, F.concat(whole, parts)).otherwise(single)


def word_terms(w: Column) -> Column:
    """Terms of one identifier."""
    none = F.array().cast("array<string>")
    low = F.lower(w)
    single = F.when(F.length(low) >= 2, F.array(low)).otherwise(none)
    return F.when(low.isin(*STOPWORDS), none).when(_is_plain(w, low), single).otherwise(_compound_terms(w, low))


def tokenize(text: Column) -> Column:
    """Terms of a text in order: a compound identifier gives itself (2 to 48 letters) and each of its parts."""
    return F.flatten(F.transform(words(text), word_terms))


def distinct_terms(text: Column) -> Column:
    """Terms of a text, each once; a spelling is looked at once."""
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(words(text)), word_terms)))


def term_rows(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, term) with a row for each term of a text: tokenize() as rows, which compiles to one stage. Only identifiers
    that are not plain words make an array of terms."""
    w = df.select(*keys, F.explode(words(F.col(text))).alias("_w")).withColumn("_l", F.lower("_w"))
    word, low = F.col("_w"), F.col("_l")
    w = w.where(~low.isin(*STOPWORDS)).withColumn("_p", _is_plain(word, low)).where(~F.col("_p") | (F.length(low) >= 2))
    w = w.select(*keys, "_l", "_p", F.explode_outer(F.when(~F.col("_p"), _compound_terms(word, low))).alias("_t"))
    return w.where("_p OR _t IS NOT NULL").select(*keys, F.coalesce("_t", "_l").alias("term"))


def identifiers(text: Column) -> Column:
    """Identifiers of a query: at least three letters, each spelling once regardless of case, in order."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_$.]+"), lambda p: F.regexp_replace(p, r"^\.+|\.+$", ""))
    good = F.filter(pieces, lambda p: (F.length(p) >= 3) & p.rlike(IDENTIFIER))

    def once(acc, p):
        return F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(p)), acc).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(good, F.array().cast("array<string>"), once)


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+", " "))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(CHARS_PER_TOKEN)).cast("long")


def fnv1a32(word: Column) -> Column:
    """32-bit FNV-1a of an ASCII word."""
    # Offset basis, prime and mask of the hash.
    codes = F.transform(F.split(word, ""), F.ascii)

    def step(h, c):
        return (h.bitwiseXOR(c.cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295))

    start = F.lit(2166136261).cast("long")
    return F.when(F.length(word) == 0, start).otherwise(F.aggregate(codes, start, step))


def truncate_lines(text: Column, most: int) -> Column:
    """At most `most` characters; cut at the last line end if that keeps more than half, then the mark."""
    head = F.substring(text, 1, most)
    tail = F.length(F.substring_index(head, "\n", -1))
    last = F.lit(most) - tail - 1
    cut = F.when(head.contains("\n") & (last > most * 0.5), head.substr(F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit(TRUNCATION_MARK)))


def snippet(text: Column, most: int = 240) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def round_half_up(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def escape_xml(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def cdata(text: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


# --- paths -------------------------------------------------------------------------------------------------
def to_posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def ancestors(path: Column) -> Column:
    """Directories above a path, outermost first."""
    parts = F.split(path, "/")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.size(parts) > 1, many).otherwise(F.array().cast("array<string>"))


# What counts as a test-like path, and names of entry files.
TEST_DIR = r"(^|/)(tests?|__tests__|__mocks__|spec|specs|fixtures?|mocks?|examples?|stories)(/|$)"
TEST_FILE = r"\.(test|spec|stories)\.[^/]+$"
ENTRY_STEMS = ("index", "main", "app", "server")


def path_score(path: Column) -> Column:
    depth = F.size(F.split(path, "/"))
    score = F.lit(0.5) + F.when(stem(path).isin(*ENTRY_STEMS), 0.3).otherwise(0.0) + F.when(path.startswith("src/"), 0.1).otherwise(0.0)
    score = score - F.greatest(depth - 2, F.lit(0)) * F.lit(0.05)
    score = score - F.when(path.rlike(TEST_DIR) | path.rlike(TEST_FILE), 0.5).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


# Roles of top-level directories, first match wins.
ROLES = (
    (r"^(src|lib|source)$", "source"),
    (r"^(tests?|__tests__|test-utils|spec)$", "tests"),
    (r"^(docs?|documentation)$", "documentation"),
    (r"^examples?$", "examples"),
    (r"^(scripts?|tools?|bin)$", "tooling"),
    (r"^(packages|apps|services)$", "workspace packages"),
    (r"^(config|configs?)$", "configuration"),
    (r"^(public|assets|static)$", "assets"),
    (r"^(e2e|integration)$", "tests"),
)


def role_for(directory: Column) -> Column:
    out = None
    for pattern, role in ROLES:
        out = F.when(directory.rlike(pattern), role) if out is None else out.when(directory.rlike(pattern), role)
    return out.otherwise("source")


def format_loc(n: Column) -> Column:
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000.0), F.lit("k"))).otherwise(n.cast("string"))
