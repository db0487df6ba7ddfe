"""Text functions as column expressions: normalisation, tokens, sentences, n-grams, numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lists that results depend on, in their natural order.
CURLY_FROM, CURLY_TO = "’‘“”–—", "''\"\"--"
FILLERS = ("um", "uh", "mhm", "hmm", "uh-huh", "huh", "ah", "oh")
TALL_MAN = (
    "ALPRAZolam", "LORazepam", "clonazePAM", "cloNIDine", "busPIRone", "buPROPion",
    "HYDROmorphone", "HYDROcodone", "oxyCODONE", "OxyCONTIN", "fentaNYL", "SUFentanil",
    "traMADol", "traZODone", "hydrOXYzine", "hydrALAZINE", "predniSONE", "prednisoLONE",
    "glipiZIDE", "glyBURIDE", "metFORMIN", "metroNIDAZOLE", "QUEtiapine", "OLANZapine",
    "risperiDONE", "rOPINIRole", "PARoxetine", "FLUoxetine", "DULoxetine", "levETIRAcetam",
    "lamoTRIgine", "carBAMazepine", "OXcarbazepine", "NIFEdipine", "niCARdipine",
    "sitaGLIPtin", "chlorproMAZINE", "methylPREDNISolone", "NexIUM",
    "ZyPREXA", "SEROquel", "KlonoPIN", "LaMICtal", "TEGretol",
)
STOP_WORDS = (
    "the", "and", "was", "were", "had", "has", "have", "for", "with", "that", "this", "her", "his", "their", "she", "him", "not", "any", "very", "been",
    "reported", "present", "caller", "patient", "about", "from", "than", "into",
)
SYNONYMS = {
    "intake": "intake", "eating": "intake", "eat": "intake", "ate": "intake", "appetite": "intake", "sips": "intake", "sipping": "intake",
    "drinking": "intake", "fluids": "intake", "food": "intake",
    "sleepiness": "sleepy", "sleepy": "sleepy", "sleeping": "sleepy", "sleep": "sleepy", "drowsy": "sleepy", "drowsiness": "sleepy",
}


def straight(c: Column) -> Column:
    """Curly quotes and dashes as ASCII."""
    return F.translate(c, CURLY_FROM, CURLY_TO)


def normalize(c: Column) -> Column:
    """Lower case, apostrophes gone, other signs as single blanks, an immediately repeated word once."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(straight(c)), "'", ""), "[^a-z0-9]+", " ")
    return F.regexp_replace(F.trim(plain), r"\b(\w+)( \1\b)+", "$1")


def padded_contains(text: Column, phrase: Column) -> Column:
    """A non-empty normalised phrase stands in the normalised text at word borders."""
    return (phrase != "") & F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def collapse_spelled(c: Column) -> Column:
    """Words spelled letter by letter are joined: 'M-E-R-C-E-R' becomes 'MERCER'."""
    spelled = F.regexp_extract_all(c, F.lit(r"\b((?:[A-Za-z](?:\s*[,\-.]\s*|\s+)){2,}[A-Za-z])\b"), 1)
    return F.aggregate(spelled, c, lambda text, m: F.replace(text, m, F.regexp_replace(m, "[^A-Za-z]", "")))


def sentences(c: Column) -> Column:
    """Trimmed, non-empty sentences: the text splits after . ? or ! before white space."""
    return F.filter(F.transform(F.split(c, r"(?<=[.?!])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def tokens(c: Column) -> Column:
    """Runs of letters and apostrophes, or of digits, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z']+|\d+"), 0)


def content_words(c: Column) -> Column:
    """Distinct normalised words of three characters and more, stop words out, synonyms folded."""
    fold = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    words = F.filter(F.split(normalize(c), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(fold, w), w)))


def char_grams(c: Column, n: int = 5) -> Column:
    """All character n-grams of a text, in order, by one look-ahead scan."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def numbers_in(c: Column) -> Column:
    """Numbers written in digits; the 10 of '/10' is a scale and does not count."""
    found = F.regexp_extract_all(straight(c), F.lit(r"/?(?:\d{1,2}:\d{2}|\d+(?:\.\d+)?)"), 0)
    return F.transform(F.filter(found, lambda x: x != "/10"), lambda x: F.ltrim(x, F.lit("/")))


def supported(number: Column, candidates: Column) -> Column:
    """A number is among candidates as text, without leading zeros, or as a value."""
    bare = F.coalesce(F.nullif(F.ltrim(number, F.lit("0")), F.lit("")), F.lit("0"))
    value = number.try_cast("double")
    return F.array_contains(candidates, number) | F.array_contains(candidates, bare) | F.coalesce(
        F.exists(candidates, lambda x: x.try_cast("double") == value), F.lit(False)
    )


def tall_man(c: Column, words: tuple[str, ...] = TALL_MAN) -> Column:
    """Look-alike drug names in their fixed casing, as whole words, one after the other."""
    return reduce(lambda text, w: F.regexp_replace(text, rf"(?i)\b{w}\b", w), words, c)


def stem(w: Column) -> Column:
    """A word without its last two letters, of four at least."""
    return F.left(w, F.greatest(F.lit(4), F.length(w) - 2))


def immediate_repeats(words: Column) -> Column:
    """How many words of an array equal the word before."""
    return F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))


def digits_value(c: Column) -> Column:
    """The number left when all but digits and dots are taken out; null if that is none."""
    return F.regexp_replace(c, "[^0-9.]", "").try_cast("double")
