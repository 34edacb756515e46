"""Field normalizers: Column -> Column, built from native expressions only.

A missing value is an empty string: null counts as empty, and empty stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that text normalization drops.
STOPWORDS = (
    "a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when "
    "where why how all any both each few more most other some such no nor not only own same so than too very can "
    "will just should now"
).split()
# Legal forms at the end of a name, as a pattern.
LEGAL_SUFFIX = r"\s+(inc\.?|incorporated|corp\.?|corporation|llc|ltd\.?|limited|llp|l\.l\.p\.?|pllc|p\.l\.l\.c\.?|pc|p\.c\.?)"
# Apartments and other units in an address, as a pattern.
UNIT = r"(\s+)(apt|apartment|ste|suite|unit|#)\.?\s+[a-z0-9-]+"
# Street words and their short forms.
STREETS = {
    "street": "st", "avenue": "ave", "boulevard": "blvd", "road": "rd", "lane": "ln",
    "drive": "dr", "court": "ct", "square": "sq", "parkway": "pkwy",
}
# Phone numbers and e-mail addresses, as patterns.
PHONE = r"^(?:\+?(\d{1,3}))?[-. (]*(\d{3})[-. )]*(\d{3})[-. ]*(\d{4})"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
# Codes of the states.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA",
    "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO",
    "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}

END = r"\z"
FIELDS = ("name", "address", "city", "state", "zip", "phone", "email")


@dataclass(frozen=True)
class NormalizeOptions:
    """Switches; stemming is accepted and does nothing. compat_initials keeps initials with their dots."""

    lowercase: bool = True
    stopwords: bool = True
    stemming: bool = True
    remove_legal_suffixes: bool = True
    normalize_initials: bool = True
    compat_initials: bool = False
    standardize_abbreviations: bool = True
    remove_apartment_numbers: bool = True
    e164_format: bool = True
    lowercase_domain: bool = True


DEFAULTS = NormalizeOptions()


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def trim_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+" + END, "")


def normalize_text(c: Column | str, o: NormalizeOptions = DEFAULTS) -> Column:
    """Lower case, single spaces, no stopwords."""
    out = text_of(c)
    if o.lowercase:
        out = F.lower(out)
    out = trim_spaces(F.regexp_replace(out, r"\s+", " "))
    if o.stopwords:
        words = "|".join(STOPWORDS)  # single spaces by now, so a word ends at a space or the end
        out = F.rtrim(F.regexp_replace(out, rf"(?i)(?:^|(?<= ))(?:{words})(?: |{END})", ""))
    return out


def normalize_name(c: Column | str, o: NormalizeOptions = DEFAULTS) -> Column:
    """Text rules, then one legal suffix and the dots of initials go."""
    out = normalize_text(c, o)
    if o.remove_legal_suffixes:
        out = F.regexp_replace(out, f"(?i){LEGAL_SUFFIX}{END}", "")
    if o.normalize_initials and not o.compat_initials:
        out = F.regexp_replace(out, r"(?i)(?<![0-9A-Za-z_])([a-z])\.", "$1")
    return trim_spaces(out)


def normalize_address(c: Column | str, o: NormalizeOptions = DEFAULTS) -> Column:
    """Text rules, then short street words, no units."""
    out = normalize_text(c, o)
    if o.standardize_abbreviations:
        for word, short in STREETS.items():
            out = F.regexp_replace(out, rf"(?i)(?<![0-9A-Za-z_]){word}(?![0-9A-Za-z_])\.?", short)
    if o.remove_apartment_numbers:
        out = F.regexp_replace(out, f"(?i){UNIT}", "")
    return trim_spaces(out)


def normalize_phone(c: Column | str, o: NormalizeOptions = DEFAULTS) -> Column:
    """+, country, area, number. With a plus sign and 8 to 15 bytes, or without a match, it stays as it is."""
    raw = text_of(c)
    pattern = PHONE + END
    country, area, first, last = (F.regexp_extract(raw, pattern, k) for k in range(1, 5))
    e164 = F.concat(F.lit("+"), F.when(country == "", F.lit("1")).otherwise(country), area, first, last)
    as_is = raw.startswith("+") & F.octet_length(raw).between(8, 15)
    return F.when(as_is | ~raw.rlike(pattern), raw).otherwise(e164 if o.e164_format else raw)


def normalize_email(c: Column | str, o: NormalizeOptions = DEFAULTS) -> Column:
    """Lower-cases the domain of valid addresses."""
    raw = text_of(c)
    if not o.lowercase_domain:
        return raw
    parts = F.split(raw, "@")
    return F.when(raw.rlike(EMAIL + END), F.concat(parts[0], F.lit("@"), F.lower(parts[1]))).otherwise(raw)


def normalize_state(c: Column | str, o: NormalizeOptions = DEFAULTS) -> Column:
    """Two bytes: upper case. Names of states: their code. Others stay."""
    raw = text_of(c)
    codes = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.when(F.octet_length(raw) == 2, F.upper(raw)).otherwise(F.coalesce(F.try_element_at(codes, F.lower(raw)), raw))


def normalize_zip(c: Column | str, o: NormalizeOptions = DEFAULTS) -> Column:
    """Letters and digits only; five of them when the first is a digit."""
    clean = F.regexp_replace(text_of(c), "[^0-9a-zA-Z]", "")
    return F.when((F.length(clean) >= 5) & clean.rlike("^[0-9]"), F.substring(clean, 1, 5)).otherwise(clean)


NORMALIZERS = {
    "name": normalize_name,
    "address": normalize_address,
    "city": normalize_text,
    "state": normalize_state,
    "zip": normalize_zip,
    "phone": normalize_phone,
    "email": normalize_email,
}


def normalize_entity(df: DataFrame, o: NormalizeOptions = DEFAULTS) -> DataFrame:
    """Adds <field>_normalized for each known field that the frame has."""
    return df.withColumns({f"{f}_normalized": NORMALIZERS[f](f, o) for f in FIELDS if f in df.columns})


def combine_fields(df: DataFrame, fields: list[str] | None = None) -> Column:
    """Non-empty values joined by spaces, in the order of the field names."""
    names = sorted(fields if fields is not None else [c for f in FIELDS for c in (f, f"{f}_normalized") if c in df.columns])
    return F.concat_ws(" ", *[F.nullif(F.col(f), F.lit("")) for f in names])


def tokenize(c: Column | str) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def digits_of(c: Column | str) -> Column:
    return F.regexp_replace(text_of(c), "[^0-9]", "")
