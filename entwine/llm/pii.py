"""PII: detected entities get keyed, type-consistent surrogates.

A surrogate depends on a secret key, the type and the canonical form of the entity alone, so all mentions of an
entity, in whatever format and document, get the same one, written in the mention's own format: separators, case,
script, digit and letter places, valid check digits, gender of names. The distinct entities of the corpus are
checked for collisions, among the surrogates and with real entities; those that collide draw again.

Names are replaced word by word: a given name and a family name have surrogates of their own, so "Mr John Smith",
"Dr Smith" and "Smith" agree. An honorific announces a name; once announced, its words are replaced wherever else they
stand in the document, with or without honorific. A given name is male or female if the corpus knows it with
honorifics of one gender only.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_staged, map_text, ship_package, staged

# Honorifics that announce a name, by the gender they tell.
HONORIFICS = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña"],
    "n": ["Dr", "Prof"],
}
# Names to draw from, by gender and script.
FIRST = {
    ("m", "latin"): "Adam Alan Albert Alec Andrew Anton Arthur Bruno Carl Cedric Colin Daniel David Dennis Edgar Edwin Emil Eric Felix Frank Georg Gilbert Gordon Harold Henry Hugo Ivan Jacob Jonas Julian Karl Leon Louis Lucas Marcel Martin Max Nathan Oliver Oscar Paul Peter Ralph Robin Roman Samuel Simon Stefan Theo Thomas Victor Walter".split(),
    ("f", "latin"): "Ada Agnes Alice Amelia Anna Barbara Beatrice Carla Cecilia Clara Diana Dora Edith Elena Elisa Emma Erica Esther Eva Flora Frida Gloria Greta Hanna Helen Ida Irene Jana Julia Karin Laura Lea Lena Linda Lucia Maria Marta Mona Nadia Nina Nora Olga Paula Petra Rita Rosa Ruth Sara Silvia Sofia Tina Vera".split(),
    ("m", "cyrillic"): "Андрей Антон Борис Виктор Глеб Денис Егор Иван Игорь Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур Фёдор Юрий".split(),
    ("f", "cyrillic"): "Алла Анна Вера Галина Дарья Елена Жанна Зоя Инна Ирина Лидия Майя Нина Ольга Полина Раиса София Тамара Ульяна Юлия".split(),
}
LAST = {
    "latin": "Abel Baker Barlow Becker Bender Bishop Brandt Carver Conrad Cooper Dalton Decker Ebert Ellis Farmer Fischer Foster Garner Gerber Harper Hartmann Hobbs Jansen Keller Kramer Lambert Lang Marlow Mercer Meyer Miller Norman Osborn Palmer Porter Quinn Ritter Sander Shepard Steiner Tanner Turner Vogel Wagner Walker Weber Wells Winter York Ziegler".split(),
    "cyrillic": "Белов Волков Громов Дроздов Ершов Жуков Зимин Карпов Лебедев Мельник Носов Орлов Попов Рябов Соколов Титов Уваров Филин Чижов Шубин".split(),
}
_GENDER = {h: g for g, hs in HONORIFICS.items() for h in hs}
_TITLES = "|".join(sorted(_GENDER, key=len, reverse=True))

PATTERNS: list[tuple[str, re.Pattern]] = [
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----")),
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9_][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?(?P<v>[^\s\"'<>,;]{6,})")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}(?![0-9A-Za-z])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)", re.A)),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w|[.-]\d)|(?<![\w+])\+\d{8,15}(?!\w)", re.A)),
    ("card", re.compile(r"(?<![\w-])(?<!\d\.)(?:(?:\d{4}[ -]){3}\d{1,7}|\d{13,19})(?![\w-])", re.A)),
    ("name", re.compile(rf"(?<!\w)(?P<h>{_TITLES})(?:\.[  ]?|[  ])(?:[^\W\d_a-z]\.[  ]?){{0,3}}(?P<v>[^\W\d_a-z][^\W\d_]+(?:[  -][^\W\d_a-z][^\W\d_]+){{0,2}})(?!\w)")),
]
_DIGITS = {"phone", "ssn", "card"}
_NAMES = {"given", "family"}
_WORD = re.compile(r"[^\W\d_]+")
# Country codes of one and two digits (ITU-T E.164); all others have three.
_COUNTRY = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
_digit_or_at = re.compile(r"[0-9@]")
# What a text without digits and @ needs to hold an entity.
_signs = [*_GENDER, "PRIVATE KEY", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox"]
_key_signs = ("token", "secret", "passw", "pwd", "key")


def hints(text: str) -> bool:
    """Cheap test that only texts without entities fail."""
    if _digit_or_at.search(text) or any(s in text for s in _signs):
        return True
    return ("=" in text or ":" in text) and any(s in low for low in [text.lower()] for s in _key_signs)


def luhn(digits: str) -> int:
    """The sum of the Luhn check modulo 10; 0 for valid numbers."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10


def iban_ok(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def national(text: str) -> str:
    """The digits of a phone number without country code and trunk zero."""
    digits = re.sub(r"\D", "", text)
    if text.startswith("+"):
        code = next((n for n in (1, 2) if digits[:n] in _COUNTRY), 3)
        rest = digits[code:]
    elif len(digits) == 11 and digits[0] == "1":
        rest = digits[1:]
    else:
        rest = digits
    rest = rest[1:] if rest[:1] == "0" else rest
    return rest if len(rest) >= 4 else digits


def canonical(kind: str, text: str) -> str:
    if kind == "phone":
        return national(text)
    if kind in _DIGITS:
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "email":
        return text.lower()
    if kind in _NAMES:
        return text.casefold()
    return text


Mention = tuple[int, int, str, str, str]  # start, end, kind, canonical value, gender of a given name


def _spans(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and gender of whatever a pattern finds; names as a whole."""
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            a, b = m.span("v") if "v" in pattern.groupindex else m.span()
            if kind == "iban" and not iban_ok(canonical(kind, text[a:b])):
                continue
            if kind == "secret" and not any(c.isalnum() for c in text[a:b]):  # a mask, such as ******
                continue
            yield a, b, kind, _GENDER[m["h"]] if kind == "name" else ""


def find(text: str | None) -> list[Mention]:
    """Entities of a text, without overlaps, in order; of names each word is one."""
    if not text or not hints(text):
        return []
    plain: list[tuple[int, int, str, str]] = []
    end = 0
    for x in sorted(_spans(text), key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            plain.append(x)
            end = x[1]
    out: list[Mention] = [(a, b, kind, canonical(kind, text[a:b]), "") for a, b, kind, _ in plain if kind != "name"]
    named = [(a, b, gender) for a, b, kind, gender in plain if kind == "name"]
    return sorted(out + _names(text, named, out)) if named else out


def _names(text: str, named: list[tuple[int, int, str]], others: list[Mention]) -> list[Mention]:
    """The words of the announced names, and where else in the text they stand."""
    words = [[(a + m.start(), a + m.end()) for m in _WORD.finditer(text[a:b])] for a, b, _ in named]
    low = lambda w: canonical("given", text[w[0] : w[1]])
    given = {low(w) for ws in words for w in ws[:-1]}
    family = {low(ws[-1]) for ws in words if len(ws) > 1}
    genders: dict[str, set[str]] = {}
    for ws, (_, _, gender) in zip(words, named):
        first = ws[:-1] if len(ws) > 1 else ws
        for w in first:
            genders.setdefault(low(w), set()).update({gender} - {"n"})
    kind = lambda w: "given" if w in given and w not in family else "family"
    gender = lambda w: next(iter(genders[w])) if kind(w) == "given" and len(genders.get(w, ())) == 1 else "n" if kind(w) == "given" else ""
    seen = {w for ws in words for w in ws}
    taken = sorted(seen | {m[:2] for m in others})
    forms = {f for ws in words for w in ws for f in (text[w[0] : w[1]], text[w[0] : w[1]].upper(), text[w[0] : w[1]].capitalize())}
    again = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, forms), key=lambda f: (-len(f), f)))})(?!\w)")
    for m in again.finditer(text):
        k = bisect_right(taken, (m.end(), -1)) - 1  # the last one that begins before the end of this
        if k < 0 or taken[k][1] <= m.start():
            seen.add(m.span())
    return [(a, b, kind(w), w, gender(w)) for a, b in seen for w in [low((a, b))]]


def _stream(key: bytes, kind: str, value: str, attempt: int) -> Iterator[int]:
    n = 0
    while True:
        yield from hashlib.blake2b(f"{kind}\0{value}\0{attempt}\0{n}".encode("utf-8", "surrogatepass"), key=key, digest_size=64).digest()
        n += 1


def _pick(stream: Iterator[int], n: int) -> int:
    """An even draw from 0 to n - 1."""
    x = 0
    for _ in range(4):
        x = x << 8 | next(stream)
    return x % n


def _like(c: str, s: Iterator[int], hexa: bool) -> str:
    """A character of the same kind and case; letters of other scripts stay in the script's block if it has more."""
    if c.isdigit() and c.isascii():
        return str(_pick(s, 10))
    if "a" <= c <= "z":
        return "abcdef"[_pick(s, 6)] if hexa else chr(97 + _pick(s, 26))
    if "A" <= c <= "Z":
        return "ABCDEF"[_pick(s, 6)] if hexa else chr(65 + _pick(s, 26))
    if c.isalpha():
        for _ in range(20):
            d = chr(ord(c) // 32 * 32 + _pick(s, 32))
            if d.isalpha() and d.isupper() == c.isupper():
                return d
        return chr(97 + _pick(s, 26))
    if c.isdecimal():
        return chr(ord(c) - unicodedata.decimal(c) + _pick(s, 10))
    return str(_pick(s, 10)) if c.isalnum() else c


def script_of(value: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in value) else "latin" if any(c.isascii() and c.isalpha() for c in value) else "other"


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0, gender: str = "n") -> str:
    """The canonical form of the replacement; differs from the value, and names share no part with it."""
    for turn in range(1000):
        s = _stream(key, kind, value, attempt * 1000 + turn)
        out = _draw(key, s, kind, value, attempt, gender)
        if out != value and not (kind in _NAMES and value in out.split("-")):
            return out
    return out


def _draw(key: bytes, s: Iterator[int], kind: str, value: str, attempt: int, gender: str) -> str:
    more = attempt // (3 if kind in _NAMES else 8)  # small spaces run out: in later attempts, surrogates get longer
    letters = lambda: "".join(chr(97 + _pick(s, 26)) for _ in range(more))
    if kind == "ip":
        return ".".join(str(1 + _pick(s, 254)) for _ in range(4 + more))
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        for turn in range(100):
            d = _stream(key, "domain", domain, turn)  # one surrogate for all addresses of a domain
            new = "".join(_like(c, d, False) for c in host)
            if new != host:
                break
        return "".join(_like(c, s, False) for c in local) + letters() + "@" + new + "." + top
    if kind in ("phone", "ssn", "card"):
        hold = 1 if kind == "card" else 0
        out = value[:hold] + "".join(str(_pick(s, 10)) if i else str(2 + _pick(s, 8)) for i in range(len(value) - hold + more))
        if kind == "card" and luhn(value) == 0:
            out = next(out[:-1] + str(c) for c in range(10) if luhn(out[:-1] + str(c)) == 0)
        return out
    if kind == "iban":
        body = "".join(_like(c, s, False) for c in value[4:]) + "".join(str(_pick(s, 10)) for _ in range(more))
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind in _NAMES:
        script = script_of(value)
        if script == "other":
            return "".join(_like(c, s, False) for c in value) + letters()
        drawn = gender if gender in ("m", "f") else "mf"[_pick(s, 2)]
        names = LAST[script] if kind == "family" else FIRST[drawn, script]
        return "-".join(names[_pick(s, len(names))] for _ in range(1 + more)).casefold()
    start = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-", value)
    hold = start.end() if start else 0
    hexa = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None
    if kind == "private_key":
        a, b = value.index("-----", 10) + 5, value.rindex("-----END")
        return value[:a] + "".join(_like(c, s, False) for c in value[a:b]) + letters() + value[b:]
    return value[:hold] + "".join(_like(c, s, hexa) for c in value[hold:]) + "".join("abcdef"[_pick(s, 6)] if hexa else chr(97 + _pick(s, 26)) for _ in range(more))


def render(kind: str, mention: str, value: str) -> str:
    """Writes a canonical surrogate in the format of a mention."""
    if kind == "phone":  # country code and trunk zero stay
        hold = sum(c.isdigit() for c in mention) - len(canonical(kind, mention))
        rest, out = iter(value), []
        for c in mention:
            if c.isdigit() and hold:
                hold -= 1
                out.append(c)
            else:
                out.append(next(rest) if c.isdigit() else c)
        return "".join(out) + "".join(rest)
    if kind in _DIGITS or kind == "iban":
        rest = iter(value)
        return "".join(next(rest) if c.isalnum() else c for c in mention) + "".join(rest)
    if kind == "email":
        parts = zip(mention.rsplit("@", 1), value.rsplit("@", 1))
        return "@".join("".join(v.upper() if m.isupper() else v for m, v in zip(a.ljust(len(b)), b)) for a, b in parts)
    if kind in _NAMES:
        return value.upper() if len(mention) > 1 and mention.isupper() else "-".join(x[:1].upper() + x[1:] for x in value.split("-"))
    return value


Known = dict[tuple[str, str], tuple[int, str]]  # attempt and gender of the entities that the corpus decides on


def replace(text: str | None, key: bytes, known: Known) -> tuple[str | None, list[dict]]:
    found = find(text)
    if not found:
        return text, []
    out, at, notes = [], 0, []
    for a, b, kind, value, gender in found:
        attempt, gender = known.get((kind, value), (0, gender))
        new = render(kind, text[a:b], surrogate(key, kind, value, attempt, gender))
        out += [text[at:a], new]
        notes.append({"kind": kind, "start": a, "end": b, "surrogate": new})
        at = b
    return "".join(out) + text[at:], notes


ENTITY_FIELDS = ("kind", "value", "gender")
ENTITIES = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ENTITY_FIELDS]))
NOTES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("surrogate", T.StringType())]))


def _listed(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The distinct entities of each document."""
    make = lambda: lambda texts: [[[dict(zip(ENTITY_FIELDS, e)) for e in dict.fromkeys(x[2:] for x in find(t))] for t in texts]]
    return map_text(docs, text_col, [T.StructField("entities", ENTITIES)], make, keep=keep).select(*keep, F.explode("entities").alias("e")).select(*keep, "e.*")


def key_of_environment() -> bytes:
    """The key of the entry points: ENTWINE_PII_KEY. Without it a fixed one, with which anybody can draw the same surrogates."""
    return os.environ.get("ENTWINE_PII_KEY", "a key that everybody knows").encode()


def entity_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct entities of all documents: kind, value, gender (of given names: m or f if no document tells another)."""
    least, most = F.min(F.when(F.col("gender") != "n", F.col("gender"))), F.max(F.when(F.col("gender") != "n", F.col("gender")))
    by_value = _listed(docs, text_col, []).groupBy("kind", "value").agg(least.alias("x"), most.alias("y"))
    return by_value.select("kind", "value", F.when(F.col("x") == F.col("y"), F.col("x")).when(F.col("kind") == "given", "n").otherwise("").alias("gender"), (F.col("x") < F.col("y")).alias("both"))


def draw_again(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt, gender of the entities that do not keep their first surrogate: attempts until all are distinct.

    In each round an entity keeps its draw if it is no real entity's value and no smaller value of the kind drew
    the same. Draws of one round see those kept before as taken. The space of draws grows with the attempts, so the
    rounds come to an end.
    """
    ship_package(entities.sparkSession)

    @F.pandas_udf("string")
    def draw(kind: pd.Series, value: pd.Series, attempt: pd.Series, gender: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, int(a), g) for k, v, a, g in zip(kind, value, attempt, gender)], dtype=object)

    cols = ["kind", "value", "gender", "attempt"]

    def drawn(df: DataFrame) -> DataFrame:
        return df.select(*cols, draw("kind", "value", "attempt", "gender").alias("new"))

    real = entities.select("kind", F.col("value").alias("new")).distinct().withColumn("real", F.lit(True))
    now = staged(drawn(entities.withColumn("attempt", F.lit(0))), "pii_draws")
    while True:
        first = now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("first"))
        judged = now.join(first, ["kind", "new"]).join(real, ["kind", "new"], "left")
        bad = judged.filter(F.col("real").isNotNull() | (F.struct("attempt", "value") > F.col("first")))
        bad = staged(bad.select("kind", "value", "gender", (F.col("attempt") + 1).alias("attempt")), "pii_again")
        if bad.isEmpty():
            break
        rest = now.join(bad.select("kind", "value"), ["kind", "value"], "left_anti")
        after = staged(rest.select(*cols, "new").unionByName(drawn(bad)), "pii_draws")
        drop_staged(now)
        drop_staged(bad)
        now = after
    return now.filter("attempt > 0").select(*cols)


def replace_entities(docs: DataFrame, key: bytes, text_col: str = "text", most_broadcast: int = 50_000) -> DataFrame:
    """Replaces the text by one with surrogates and adds n_entities and entities (kind, start, end, surrogate).

    start and end are places in the input text. Null and empty texts pass unchanged with no entities. Rows are
    independent: repeated rows get equal results. Input columns named n_entities or entities give way.
    Very long texts are searched as they are. Entities that had to draw again, and given names whose gender the corpus
    tells, are few; up to most_broadcast of them go to the executors as a dictionary.
    Beyond that each document gets its own through a join on the hash of its text.
    """
    entities = staged(entity_table(docs, text_col), "pii_entities")
    again = draw_again(entities.drop("both"), key)
    told = entities.filter("gender IN ('m', 'f') OR both").select("kind", "value", "gender", F.lit(0).alias("attempt"))
    again = staged(again.unionByName(told).groupBy("kind", "value").agg(F.max("attempt").alias("attempt"), F.max("gender").alias("gender")), "pii_attempts")
    n = again.count()
    cols = [c for c in docs.columns if c not in ("n_entities", "entities")]
    fields = [T.StructField("__new", T.StringType()), T.StructField("entities", NOTES)]
    if n <= most_broadcast:
        known = {(r["kind"], r["value"]): (r["attempt"], r["gender"]) for r in again.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def make():
            return lambda texts: [list(c) for c in zip(*(replace(t, key, shared.value) for t in texts))]

        out = map_text(docs.select(*[F.col(f"`{c}`") for c in cols]), text_col, fields, make)
    else:
        sep = "\0"
        text_key = F.sha2(F.col(f"`{text_col}`").cast("binary"), 256)
        found = _listed(docs.select(F.col(f"`{text_col}`").alias("t"), text_key.alias("tk")), "t", ["tk"]).select("tk", "kind", "value")
        of_text = found.distinct().join(again, ["kind", "value"]).groupBy("tk").agg(F.to_json(F.collect_list(F.array("kind", "value", F.col("attempt").cast("string"), "gender"))).alias("own"))
        joined = docs.select(*[F.col(f"`{c}`") for c in cols], text_key.alias("__tk")).join(staged(of_text.withColumnRenamed("tk", "__tk"), "pii_of_text"), "__tk", "left")
        packed = joined.withColumn("__both", F.when(F.col(f"`{text_col}`").isNotNull(), F.concat(F.coalesce("own", F.lit("[]")), F.lit(sep), F.col(f"`{text_col}`"))))

        def make():
            import json

            def one(both):
                if both is None:
                    return None, []
                own, text = both.split(sep, 1)
                return replace(text, key, {(k, v): (int(a), g) for k, v, a, g in json.loads(own)})

            return lambda texts: [list(c) for c in zip(*(one(t) for t in texts))]

        out = map_text(packed, "__both", fields, make, keep=cols)
    return out.select(*[F.col("__new").alias(c) if c == text_col else F.col(f"`{c}`") for c in cols], F.size("entities").cast("long").alias("n_entities"), "entities")
