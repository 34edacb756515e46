"""Comparators: (Column, Column) -> Column of doubles from 0 to 1.

Rule for empty values (null counts as empty): two are alike (1), one alone is not (0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jaro import jaro, jaro_winkler, jaro_winkler_of
from .normalize import END, LEGAL_SUFFIX, UNIT, digits_of, text_of, tokenize, trim_spaces

Comparator = Callable[[Column, Column], Column]

# Street types and directions in addresses, and their short forms.
STREET_TYPES = {
    "street": "st", "st": "st", "avenue": "ave", "ave": "ave", "boulevard": "blvd", "blvd": "blvd",
    "road": "rd", "rd": "rd", "drive": "dr", "dr": "dr", "lane": "ln", "ln": "ln", "court": "ct", "ct": "ct",
    "circle": "cir", "cir": "cir", "place": "pl", "pl": "pl", "way": "way", "parkway": "pkwy", "pkwy": "pkwy",
    "highway": "hwy", "hwy": "hwy", "expressway": "way",
}
DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w"}


def _rule(a: Column, b: Column, score: Column) -> Column:
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(score)


def _pair(a, b) -> tuple[Column, Column]:
    return text_of(a), text_of(b)


def exact(a, b) -> Column:
    a, b = _pair(a, b)
    return (a == b).cast("double")


def case_insensitive(a, b) -> Column:
    a, b = _pair(a, b)
    return (F.lower(a) == F.lower(b)).cast("double")


def jaro_similarity(a, b) -> Column:
    return jaro(*_pair(a, b))


def jaro_winkler_similarity(a, b) -> Column:
    return jaro_winkler(*_pair(a, b))


def levenshtein_similarity(a, b) -> Column:
    """Distance in characters over the greater length in bytes."""
    a, b = _pair(a, b)
    return _rule(a, b, 1 - F.levenshtein(a, b) / F.greatest(F.octet_length(a), F.octet_length(b), F.lit(1)))


def jaccard(a, b) -> Column:
    """Of token sets; values without any token give 0."""
    a, b = _pair(a, b)
    x, y = tokenize(a), tokenize(b)
    n = F.size(F.array_union(x, y))
    return _rule(a, b, F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(n, F.lit(1))))


def token_cosine(a, b) -> Column:
    """Of token counts."""
    a, b = _pair(a, b)
    x, y = tokenize(a), tokenize(b)
    count = lambda tokens, w: F.size(F.filter(tokens, lambda t: t == w)).cast("double")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.transform(F.array_intersect(x, y), lambda w: count(x, w) * count(y, w)))
    norm = lambda tokens: F.sqrt(total(F.transform(F.array_distinct(tokens), lambda w: count(tokens, w) * count(tokens, w))))
    size = norm(x) * norm(y)
    return _rule(a, b, F.when(size == 0, 0.0).otherwise(dot / F.when(size == 0, 1.0).otherwise(size)))


def contained_in(a, b, ignore_case: bool = True) -> Column:
    """Length of the shorter over the longer when one contains the other."""
    a, b = _pair(a, b)
    x, y = (F.lower(a), F.lower(b)) if ignore_case else (a, b)
    n, m = F.octet_length(x), F.octet_length(y)
    return _rule(a, b, F.when(F.contains(x, y) | F.contains(y, x), F.least(n, m) / F.greatest(n, m, F.lit(1))).otherwise(0.0))


def clean_name(c: Column) -> Column:
    out = F.regexp_replace(F.lower(c), LEGAL_SUFFIX + END, "")
    return F.regexp_replace(trim_spaces(out), r"\s+", " ")


def name_similarity(a, b) -> Column:
    a, b = _pair(a, b)
    near = jaro_winkler_of(clean_name(a), clean_name(b))
    x, y = near["a"], near["b"]
    blend = 0.6 * near["score"] + 0.3 * jaccard(x, y) + 0.1 * contained_in(x, y)
    return _rule(a, b, F.when((a == b) | (F.lower(x) == F.lower(y)), 1.0).otherwise(blend))


def _words_to(c: Column, table: dict[str, str]) -> Column:
    """Replaces whole words, several for the same short form in one pass."""
    by_short: dict[str, list[str]] = {}
    for word, short in table.items():
        if word != short:
            by_short.setdefault(short, []).append(word)
    for short, words in by_short.items():
        c = F.regexp_replace(c, rf"(?<![0-9A-Za-z_])(?:{'|'.join(words)})(?![0-9A-Za-z_])", short)
    return c


def clean_address(c: Column) -> Column:
    out = F.regexp_replace(F.lower(c), UNIT, "")
    out = _words_to(_words_to(out, STREET_TYPES), DIRECTIONS)
    return F.regexp_replace(trim_spaces(out), r"\s+", " ")


def address_similarity(a, b) -> Column:
    a, b = _pair(a, b)
    near = jaro_winkler_of(clean_address(a), clean_address(b))
    x, y = near["a"], near["b"]
    first = lambda c: F.regexp_extract(c, r"([0-9]+)", 1)
    other = (first(x) != "") & (first(y) != "") & (first(x) != first(y))
    blend = 0.5 * jaccard(x, y) + 0.2 * near["score"] + 0.3 * contained_in(x, y)
    return _rule(a, b, F.when((a == b) | (F.lower(x) == F.lower(y)), 1.0).otherwise(blend * F.when(other, 0.3).otherwise(1.0)))


def phone_similarity(a, b) -> Column:
    """By the common end of the last ten digits."""
    a, b = _pair(a, b)
    x, y = digits_of(a), digits_of(b)
    p, q = F.right(x, F.lit(10)), F.right(y, F.lit(10))
    agree = lambda k: (F.length(p) >= k) & (F.length(q) >= k) & (F.right(p, k) == F.right(q, k))
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(10)), agree))
    score = F.element_at(F.array(*[F.lit(v) for v in (0.0, 0.1, 0.2, 0.3, 0.7, 0.7, 0.7, 0.9, 0.9, 0.9, 1.0)]), same + 1)
    return _rule(a, b, _rule(x, y, F.when(x == y, 1.0).otherwise(score)))


def email_similarity(a, b) -> Column:
    a, b = _pair(a, b)
    parts = r"^([^@]+)@((?s:.+))" + END
    user = lambda c: F.regexp_extract(c, parts, 1)
    domain = lambda c: F.lower(F.regexp_extract(c, parts, 2))
    whole = ~a.rlike(parts) | ~b.rlike(parts)
    near = jaro_winkler_similarity(F.when(whole, a).otherwise(user(a)), F.when(whole, b).otherwise(user(b)))
    score = F.when(whole, near).when(domain(a) != domain(b), 0.0).otherwise(0.4 * near + 0.6)
    return _rule(a, b, F.when(a == b, 1.0).when(F.lower(a) == F.lower(b), 0.99).otherwise(score))


def zip_similarity(a, b) -> Column:
    """By the common start of the first five digits."""
    a, b = _pair(a, b)
    x, y = digits_of(a), digits_of(b)
    starts = lambda k: (F.length(x) >= k) & (F.length(y) >= k) & (F.substring(x, 1, k) == F.substring(y, 1, k))
    score = F.when(starts(5), 0.95).when(starts(3), 0.8).when(starts(1), 0.5).otherwise(0.0)
    return _rule(a, b, _rule(x, y, F.when(x == y, 1.0).otherwise(score)))


#: Comparators by the name that results report.
FUNCTIONS: dict[str, Comparator] = {
    "ExactMatch": exact,
    "CaseInsensitiveMatch": case_insensitive,
    "Jaro": jaro_similarity,
    "JaroWinkler": jaro_winkler_similarity,
    "Levenshtein": levenshtein_similarity,
    "Jaccard": jaccard,
    "Cosine": token_cosine,
    "ContainedIn": contained_in,
    "NameSimilarity": name_similarity,
    "AddressSimilarity": address_similarity,
    "PhoneSimilarity": phone_similarity,
    "EmailSimilarity": email_similarity,
    "ZipCodeSimilarity": zip_similarity,
}
DEFAULT = "JaroWinkler"
# Other names of the comparators.
ALIASES = {
    "NameSimilarity": "name namesimilarity",
    "AddressSimilarity": "address addresssimilarity",
    "PhoneSimilarity": "phone phonesimilarity phonenumber",
    "EmailSimilarity": "email emailsimilarity",
    "ZipCodeSimilarity": "zipcode postalcode zip",
    "JaroWinkler": "text default jaro jarowinkler",
    "ExactMatch": "exact exactmatch",
    "CaseInsensitiveMatch": "case caseinsensitive caseinsensitivematch",
    "Levenshtein": "levenshtein editdistance",
    "Jaccard": "jaccard token",
    "Cosine": "cosine cosinesimilarity",
    "ContainedIn": "contains containedin",
}
# Types of fields.
FIELD_TYPES = {
    "NameSimilarity": "name business_name person_name company organization",
    "AddressSimilarity": "address street street_address mailing_address",
    "PhoneSimilarity": "phone phone_number telephone mobile cell fax",
    "EmailSimilarity": "email email_address",
    "ZipCodeSimilarity": "zip zipcode postal_code postal",
}
# Parts of field names that tell a comparator, in the order they are tried.
NAME_PARTS = [
    ("NameSimilarity", ("name", "company", "business", "organization")),
    ("AddressSimilarity", ("address", "street")),
    ("PhoneSimilarity", ("phone", "tel", "mobile", "cell", "fax")),
    ("EmailSimilarity", ("email",)),
    ("ZipCodeSimilarity", ("zip", "postal")),
]
_BY_NAME = {alias: name for name, aliases in ALIASES.items() for alias in aliases.split()}
_BY_TYPE = {t: name for name, types in FIELD_TYPES.items() for t in types.split()}


def by_name(name: str) -> str:
    return _BY_NAME.get(name.lower(), DEFAULT)


def by_field_type(kind: str) -> str:
    return _BY_TYPE.get(kind.lower(), DEFAULT)


def infer(field: str) -> str:
    """The comparator for a field, by its name."""
    low = field.lower()
    return next((name for name, parts in NAME_PARTS if any(p in low for p in parts)), DEFAULT)


def infer_column(c: Column) -> Column:
    """infer() for a column of field names."""
    low = F.lower(c)
    out = None
    for name, parts in NAME_PARTS:
        test = low.rlike("|".join(parts))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(DEFAULT)
