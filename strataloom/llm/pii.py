"""Surrogates for personal data.

Entities are found by one pattern over the whole text: e-mail addresses, phone numbers, IPv4 addresses, payment
cards (with a valid check digit), values assigned to a setting whose name says that they are secret, and names after a title or a known
given name. Each is replaced by a value of its own kind and format that a keyed hash of its canonical form
picks, so an entity has the same surrogate everywhere. Given names change within their gender and script;
titles stay; surnames are built in the script of the original, with its gendered ending.

Surrogates are checked over the whole corpus: one that another entity has too, or that is itself an entity of
the corpus, gets another attempt, until none is left. Only entities that needed one are looked up again
when texts are rewritten; for all others the surrogate is a function of the text. All of it is DataFrame code.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import staged

KEY = "strataloom-surrogates-1"
#: Rounds of new attempts before the search for free surrogates is given up with an error.
ATTEMPTS = 40

# Titles, and given names by gender and script.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Господин", "Госпожа")
GIVEN = {
    ("f", "latin"): ("Anna", "Barbara", "Carmen", "Claire", "Elena", "Emma", "Greta", "Heidi", "Ingrid", "Julia", "Laura", "Linda", "Lucía", "Maria", "Marie", "Mary", "Patricia", "Sarah", "Sofía", "Susan"),
    ("m", "latin"): ("Antonio", "Carlos", "David", "François", "Frank", "Hans", "James", "Javier", "John", "José", "Jürgen", "Karl", "Luis", "Michael", "Paul", "Peter", "Pierre", "Robert", "Thomas", "William"),
    ("f", "cyrillic"): ("Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"),
    ("m", "cyrillic"): ("Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей"),
}
CONSONANTS, VOWELS = "bdfgklmnprstvz", "aeiou"
CYRILLIC_CONSONANTS, CYRILLIC_VOWELS = "бвгдзклмнпрстф", "аеиоу"

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}_%+\-][\p{L}\p{N}._%+\-]*+@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+"
#: International forms with + or 00, area codes in brackets, 3-3-4 with separators, and forms with a leading 0.
GROUPS = r"[ .\-]?(?:\(\d{1,4}\)|\d{2,4})[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?![\p{L}\p{N}])"
INTERNATIONAL = rf"(?<![\p{{L}}\p{{N}}+])(?:\+\d{{1,3}}|(?<![.,/\-])00[1-9]\d{{0,2}})(?:{GROUPS}|(?:[ .\-/]{{0,2}}\(?\d{{1,4}}\)?){{2,5}})"
BRACKETS = r"(?:1[ .\-]?)?\(\d{2,5}\)[ .\-]?\d{2,4}(?:[ .\-]?\d{2,4}){1,2}"
THREES = r"(?:1[ .\-])?(?:\d{3}-\d{3}-|\d{3}\.\d{3}\.|[2-9]\d\d [2-9]\d\d[ \-])\d{4}"
ZERO = r"0[1-9](?:(?:[ .\-]\d{2}){4}|\d{8,9}|\d{1,4}[ .\-/]\d{3,8}(?:[ .\-]\d{2,4}){0,2})"
PHONE = rf"(?:{INTERNATIONAL}|(?<![\p{{L}}\p{{N}}+.,/\-])(?=[01(2-9])(?:{BRACKETS}|{THREES}|{ZERO})(?![.,/\-]\d))(?![\p{{L}}\p{{N}}])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\p{{N}}]|\.\d)"
CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}+|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{4,5})(?![\p{L}\p{N}])"
#: A match of SECRET starts at the setting's name; OPENED is what stands before the value: name, = or :, opening quote.
SETTING = r"""(?=[TtSsPpAa])(?i:token|secret|password|passwd|passphrase|pwd|(?:api|access|secret|private)[_\-]?key)\\?["'`]?\]?\s{0,8}[=:]{1,2}>?[ \t]*+(?:\r?\n[ \t]*+){0,2}(?:(?i:bearer|basic)[ \t]++)?"""
OPENED = SETTING + r"""(?:[rRbBuUfF]{0,2}\\?["'`]{1,3})?"""
CLOSED = "|".join(rf"[rRbBuUfF]{{0,2}}{q}(?!{q})[^{q}\\\r\n]*+(?:\\.[^{q}\\\r\n]*+)*+(?={q})" for q in "\"'`")
SECRET = rf"""{SETTING}(?:{CLOSED}|(?!["'`]{{2}}[,;)}}\]])(?:[rRbBuUfF]{{0,2}}\\?["'`]{{1,3}})?+(?!(?i:null|none|true|false)(?:[\s,;)}}\]]|$))(?=[^=:>])[^\s"'`]*[^\s"'`\\,;.)}}\]])"""
NAME = r"\p{Lu}[\p{L}'\-]++"
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.? {NAME}(?: {NAME})?|(?:{'|'.join(n for names in GIVEN.values() for n in names)}) {NAME})"
PATTERN = "|".join((SECRET, EMAIL, PHONE, IP, CARD, PERSON))

def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def characters(text: str) -> str:
    return f"split({text}, '')"


def luhn(digits: str) -> str:
    """SQL for the sum of the digits of a card number as its check digit counts them; a valid one's is a multiple of 10."""
    return f"aggregate(transform({characters(f'reverse({digits})')}, (d, i) -> CASE WHEN i % 2 = 0 THEN try_cast(d AS INT) WHEN d > '4' THEN try_cast(d AS INT) * 2 - 9 ELSE try_cast(d AS INT) * 2 END), 0, (a, x) -> a + x)"


def matches_of(text: Column) -> Column:
    """All matches in order; a null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), 0), F.array().cast("array<string>"))


def kind_of(raw: str) -> str:
    """SQL for the kind of a match; NULL for digits that are no card."""
    digits = f"regexp_replace({raw}, '[^0-9]', '')"
    count = f"char_length({digits})"
    card = f"{digits} RLIKE '^(4|5[1-5]|2[2-7]|3[47]|6)' AND {luhn(digits)} % 10 = 0"
    return f"""CASE WHEN {raw} RLIKE {quoted('^' + SETTING)} THEN 'secret' WHEN contains({raw}, '@') THEN 'email'
      WHEN {raw} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN 'ip'
      WHEN {raw} RLIKE '^[0-9+(][0-9 ()./-]*$' THEN CASE WHEN {raw} RLIKE '^[+0(]' OR {count} < 13 THEN CASE WHEN {count} BETWEEN 8 AND 15 THEN 'phone' END WHEN {card} THEN 'card' END
      ELSE 'person' END"""


def canonical(kind: str, raw: str) -> str:
    """SQL for the form in which mentions of one entity agree."""
    return f"""CASE {kind} WHEN 'email' THEN lower({raw}) WHEN 'card' THEN regexp_replace({raw}, '[^0-9]', '')
      WHEN 'phone' THEN regexp_replace({raw}, '[^0-9+]', '') WHEN 'surname' THEN lower({raw}) ELSE {raw} END"""


def stream_of(kind: str, value: str, attempt: str, key: str = KEY) -> str:
    """SQL for 128 keyed hex digits."""
    seed = f"concat_ws(':', {quoted(key)}, {kind}, {attempt}, {value})"
    return f"concat(sha2({seed}, 256), sha2(concat('2', {seed}), 256))"


def number_at(stream: str, i: str) -> str:
    """SQL for the i-th number below 256 of a stream of hex digits; it starts again after 64."""
    return f"int(conv(substr({stream}, 2 * ({i} % 64) + 1, 2), 16, 10))"


def by_character(text: str, stream: str) -> str:
    """SQL: letters become letters, digits digits, case and all else stay; wholly hexadecimal values stay so. What kind of value it is, and its stream, are worked out once and not a character."""
    n = number_at("held.s", "i")
    hexadecimal = f"CASE WHEN {text} RLIKE '^(?=.*[a-f])[0-9a-f]+$' THEN '0123456789abcdef' WHEN {text} RLIKE '^(?=.*[A-F])[0-9A-F]+$' THEN '0123456789ABCDEF' END"
    return f"""transform(array(named_struct('t', {text}, 's', {stream}, 'h', {hexadecimal})), held -> array_join(transform({characters('held.t')}, (c, i) -> CASE
        WHEN held.h IS NOT NULL THEN substr(held.h, {n} % 16 + 1, 1)
        WHEN c RLIKE '[0-9]' THEN substr('0123456789', {n} % 10 + 1, 1)
        WHEN c RLIKE '\\\\p{{Lu}}' THEN char(65 + {n} % 26) WHEN c RLIKE '\\\\p{{L}}' THEN char(97 + {n} % 26) ELSE c END), ''))[0]"""


def surname(value: str, stream: str, attempt: str) -> str:
    """SQL: three syllables, one more an attempt, in the script of the original and with a feminine ending where it has one."""
    cyr = f"{value} RLIKE '\\\\p{{IsCyrillic}}'"

    def syllables(consonants: str, vowels: str) -> str:
        a, b = number_at(stream, "2 * i"), number_at(stream, "2 * i + 1")
        return f"array_join(transform(sequence(0, 2 + {attempt}), i -> concat(substr('{consonants}', {a} % {len(consonants)} + 1, 1), substr('{vowels}', {b} % {len(vowels)} + 1, 1))), '')"

    ending = f"CASE WHEN {value} RLIKE '(ова|ева|ина|ая)$' THEN 'нова' ELSE 'нов' END"
    return f"CASE WHEN {cyr} THEN concat({syllables(CYRILLIC_CONSONANTS, CYRILLIC_VOWELS)}, {ending}) ELSE concat({syllables(CONSONANTS, VOWELS)}, 'n') END"


def surrogate(kind: str, value: str, attempt: str, stream: str) -> str:
    """SQL for the surrogate of a canonical value from its keyed digits."""
    local, domain = f"substring_index({value}, '@', 1)", f"substring_index({value}, '@', -1)"
    body = f"concat(substr({value}, 1, 1), substr({by_character(value, stream)}, 2, char_length({value}) - 2))"
    check = f"(10 - ({luhn(f'concat({body}, 0)')}) % 10) % 10"
    kept = f"CASE WHEN {value} RLIKE '^[+][17]' THEN 2 WHEN {value} RLIKE '^([+]|00[17])' THEN 3 WHEN {value} LIKE '00%' THEN 4 WHEN {value} LIKE '0%' THEN 1 ELSE 0 END"
    longer = f"substr(reverse({stream}), 1, greatest({attempt} - 2, 0))"  # short values may have no free surrogate of their own length
    octets = ", ".join([f"1 + {number_at(stream, '0')} % 223", *(number_at(stream, str(i)) for i in (1, 2)), f"1 + {number_at(stream, '3')} % 254"])
    return f"""CASE {kind}
      WHEN 'email' THEN concat({by_character(local, stream)}, '@', {by_character(f"substring_index({domain}, '.', size(split({domain}, '[.]')) - 1)", f"reverse({stream})")}, '.example')
      WHEN 'phone' THEN concat(substr({value}, 1, {kept}), {by_character(f"substr({value}, 1 + {kept})", stream)})
      WHEN 'ip' THEN concat_ws('.', {octets})
      WHEN 'card' THEN concat({body}, {check})
      WHEN 'secret' THEN concat({by_character(value, stream)}, {longer})
      WHEN 'surname' THEN {surname(value, stream, attempt)} END"""


def given_names(key: str = KEY) -> dict[str, str]:
    """Each known given name's surrogate: the next in its gender and script in keyed order, so that no two share one."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}:{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def given_map(key: str = KEY) -> str:
    return f"map({', '.join(quoted(x) for pair in given_names(key).items() for x in pair)})"


TITLE_ARRAY = f"array({', '.join(quoted(t) for t in TITLES)})"
GIVEN_ARRAY = f"array({', '.join(quoted(n) for names in GIVEN.values() for n in names)})"


def units_of(matches: str) -> str:
    """SQL: each match as an array of units (raw, kind), the words of a person's name one by one, a secret after what opens it; titles, openings and digits that are no card or phone have no kind."""
    word = f"CASE WHEN array_contains({TITLE_ARRAY}, rtrim('.', w)) THEN NULL WHEN array_contains({GIVEN_ARRAY}, w) THEN 'given' ELSE 'surname' END"
    words = f"transform(split(x.m, ' '), w -> named_struct('raw', w, 'kind', {word}))"
    opened = f"regexp_extract(x.m, {quoted('^' + OPENED)}, 0)"
    secret = f"array(named_struct('raw', {opened}, 'kind', cast(NULL AS string)), named_struct('raw', substr(x.m, 1 + char_length({opened})), 'kind', x.k))"
    return f"transform(transform({matches}, m -> named_struct('m', m, 'k', {kind_of('m')})), x -> CASE WHEN x.k = 'person' THEN {words} WHEN x.k = 'secret' THEN {secret} ELSE array(named_struct('raw', x.m, 'kind', x.k)) END)"


#: The fields that are added to a unit, in this order.
FIELDS = ("raw", "kind", "value", "attempt", "stream", "surrogate")


def each_unit(units: str, **fields: str) -> str:
    """SQL: the nested arrays with further fields (SQL over u), one step a field, so that each is worked out once a unit."""
    for name, expression in fields.items():
        kept = ", ".join(f"'{k}', u.{k}" for k in FIELDS[: FIELDS.index(name)])
        units = f"transform({units}, us -> transform(us, u -> named_struct({kept}, '{name}', {expression})))"
    return units


def as_written(raw: str, kind: str, value: str) -> str:
    """SQL: the surrogate in the format of the mention; the digits of cards and phones go into its separators."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    filled = f"array_join(transform({characters(raw)}, (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN substr({digits}, char_length(regexp_replace(substr({raw}, 1, i + 1), '[^0-9]', '')), 1) ELSE c END), '')"
    cased = f"CASE WHEN {raw} = upper({raw}) AND char_length({raw}) > 1 THEN upper({value}) ELSE initcap({value}) END"
    return f"CASE WHEN {kind} IN ('card', 'phone') THEN {filled} WHEN {kind} = 'surname' THEN {cased} ELSE {value} END"


def rewritten(units: str, attempts: str, key: str = KEY) -> str:
    """SQL for what stands in place of each match; attempts: SQL for a map of 'kind:value' to the attempt, others 0."""
    steps = each_unit(
        units,
        value=canonical("u.kind", "u.raw"),
        attempt=f"coalesce({attempts}[concat(u.kind, ':', u.value)], 0)",
        stream=stream_of("u.kind", "u.value", "u.attempt", key),
        surrogate=surrogate("u.kind", "u.value", "u.attempt", "u.stream"),
    )
    new = f"CASE WHEN u.kind IS NULL THEN u.raw WHEN u.kind = 'given' THEN {given_map(key)}[u.raw] ELSE {as_written('u.raw', 'u.kind', 'u.surrogate')} END"
    return f"transform({steps}, us -> array_join(transform(us, u -> {new}), CASE WHEN element_at(us, -1).kind = 'secret' THEN '' ELSE ' ' END))"


def assigned(entities: DataFrame, key: str = KEY, attempts: int = ATTEMPTS) -> DataFrame:
    """entities (kind, value, distinct) with attempt and surrogate: no surrogate is shared within a kind or is itself an entity."""
    def made(rows: DataFrame) -> DataFrame:
        digits = rows.withColumn("stream", F.expr(stream_of("kind", "value", "attempt", key)))
        return staged(digits.withColumn("surrogate", F.expr(surrogate("kind", "value", "attempt", "stream"))).drop("stream"))

    now = made(entities.withColumn("attempt", F.lit(0)))
    real = entities.select("kind", F.col("value").alias("surrogate"))
    for _ in range(attempts):
        shared = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("keeps"), F.count("*").alias("n")).where("n > 1")
        twins = now.join(shared, ["kind", "surrogate"]).where(F.col("value") != F.col("keeps.value")).select("kind", "value")
        clash = staged(twins.union(now.join(real, ["kind", "surrogate"], "left_semi").select("kind", "value")).distinct())
        if clash.isEmpty():
            return now
        marked = now.join(clash.withColumn("again", F.lit(1)), ["kind", "value"], "left")
        now = made(marked.select("kind", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")))
    raise RuntimeError("no free surrogates are left")


def surrogate_texts(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with every entity replaced, n_entities, and kinds (the kinds found), a row of docs.

    A null text stays null with no entities; an empty one stays empty. Entities in rows that share a doc_id are
    treated alike, as all mentions of an entity are, in whatever document. Null ids are carried along. An
    empty table gives an empty table. Other columns of docs are ignored. Scripts other than Latin and
    Cyrillic have no name patterns; their other entities are found.
    """
    found = docs.select("doc_id", "text", matches_of(F.col("text")).alias("matches"))
    units = F.expr(each_unit(units_of("matches"), value=canonical("u.kind", "u.raw")))
    mentions = found.where(F.size("matches") > 0).select("doc_id", F.explode(F.flatten(units)).alias("u"))
    pairs = staged(mentions.where("u.kind IS NOT NULL AND u.kind != 'given'").select("doc_id", "u.kind", "u.value").distinct())
    again = assigned(pairs.select("kind", "value").distinct(), key).where("attempt > 0").select("kind", "value", "attempt")
    lists = pairs.join(again, ["kind", "value"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "value"), "attempt"))).alias("attempts"))
    lists = staged(lists.withColumnRenamed("doc_id", "id"))
    joined = found.join(lists, found["doc_id"].eqNullSafe(lists["id"]), "left").withColumn("attempts", F.coalesce("attempts", F.expr("cast(map() as map<string, int>)")))
    some = F.size("matches") > 0
    known = joined.select("doc_id", "text", "attempts", F.when(some, F.expr(units_of("matches"))).otherwise(F.expr("cast(array() as array<array<struct<raw: string, kind: string>>>)")).alias("units"))
    news = F.expr(rewritten("units", "attempts", key))
    whole = F.when(F.size("units") > 0, F.array_join(F.zip_with(F.split(F.col("text"), PATTERN, -1), news, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(F.col("text"))
    kinds = F.array_compact(F.flatten("units")["kind"])
    return known.select("doc_id", whole.alias("text"), F.size(kinds).cast("long").alias("n_entities"), F.array_sort(F.array_distinct(kinds)).alias("kinds"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
