"""Surrogates for personal data, with DataFrame operations alone.

Detected: e-mail addresses, phone numbers (North American and, with a country code, all others), payment cards, US social
security numbers, IPv4 addresses, secrets (keys of known form, and values that a label such as ``token =`` announces) and names
with a title. The same entity gets the same surrogate everywhere, also when written in another format (coreference): a phone
number with and without +1, an address in capitals, a surname with either title, with a given name or without, and, in a text that
has it with a title, alone. Different entities get different ones (distinctness). A surrogate is made by a keyed hash and keeps
type and format: separators, number of digits, country code, a card's first digit and whether its check digit holds, reserved
example domains, and for names the title, the script, the number of words and the gender that title or ending tells.

Collision checks: a surrogate that another entity also got, or that is itself an entity of the corpus, is made anew with the next
attempt number, over all distinct entities, until none is left. Names and addresses grow with the attempts; from GROWS on, numbers
get further digits and IPv4 addresses become IPv6 ones, so no type can run out, however many entities a corpus has.

The pattern takes time in proportion to the text: every part of it that repeats is bounded or possessive and begins at a word's start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, keep

# Titles by gender, and words that announce a secret.
MALE = r"(?:Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Don|Господин|г-н|Κύριος|Κύριο|κ\.κ)"
FEMALE = r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Doña|Госпожа|г-жа|Κυρία)"
NEUTRAL = r"(?:Dr|Prof)"
ARABIC_MALE, ARABIC_FEMALE = r"(?:السيد|الأستاذ)", r"(?:السيدة|الأستاذة)"
HAN_MALE, HAN_FEMALE = r"(?:先生)", r"(?:女士|小姐|太太)"
HAN_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕"
HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂华建国文志海红玉兰英慧巧美雅芝萍"
SECRET_LABEL = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
# Country codes of one and of two digits; all others have three.
COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_WORD = r"\p{Lu}['’]?\p{L}++(?:['’-]\p{Lu}\p{L}++)*+"
_ARABIC = r"[\p{IsArabic}&&\p{L}]++"
#: What titles begin with.
_BEGINS = "DFHMPSГгΚκ"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Type and pattern, the first that fits being taken.
PATTERNS = (
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,10}[A-Za-z]{2,24}"),
    ("phone", r"(?<![\w+])(?:(?:\+\d{1,3}+[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?=[+\d .()-]{9})\+\d{1,3}+(?:[ .-]\(?\d{1,4}+\)?){2,6}+(?!\d)|\+\d{8,15}+(?!\w)|(?<!-)\d{3}-\d{3}-\d{4}(?![\d-]))"),
    ("card", r"(?<![\w.-])(?:\d{4}[ -]?){3}\d{4}(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)"),
    ("secret", rf"(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_\w{{20,80}}+|sk[-_]\w[\w-]{{19,120}}+|xox[abprs]-[\w-]{{10,120}}+|{SECRET_LABEL}[\"']?[ ]{{0,3}}[:=][ ]{{0,3}}[\"']?(?=[^\s\"',;]{{0,40}}\d)[^\s\"',;]{{8,512}}+)"),
    ("name", rf"(?=[{_BEGINS}])(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.? {_WORD}(?: (?:\p{{Lu}}\. )?{_WORD})?|(?=[اأ])(?<!\p{{L}})(?:{ARABIC_FEMALE}|{ARABIC_MALE}) {_ARABIC}(?: ال{_ARABIC})?|(?=[\u4E00-\u9FFF])[{HAN_SURNAMES}]\p{{IsHan}}{{0,2}}?(?:{HAN_MALE}|{HAN_FEMALE})"),
)
#: All but names have a digit or an @.
NAME = PATTERNS[-1][1]
#: Nothing begins inside a word of Latin letters and digits, which rules most places out at once.
PATTERN = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for _, p in PATTERNS) + ")"
_TITLE = rf"^(?:{MALE}|{FEMALE}|{NEUTRAL}|{ARABIC_FEMALE}|{ARABIC_MALE})\.? "
_HAN_TITLE = rf"(?:{HAN_MALE}|{HAN_FEMALE})$"
_SECRET = rf"^(?:{SECRET_LABEL}[\"']?[ ]{{0,3}}[:=][ ]{{0,3}}[\"']?|AKIA|gh[pousr]_|sk[-_]|xox[abprs]-)"
#: Syllables of invented names by script: how they begin, their vowels, how they end.
SYLLABLES = {
    "IsCyrillic": ("б д ф г х к л м н п р с т в ж з", "а е и о у", ("", "н", "р", "л", "с")),
    "IsGreek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ ψ", "α ε η ι ο", ("", "ν", "ρ", "λ", "σ")),
    "IsArabic": ("ب د ف ج ح ك ل م ن ر س ت ط و ز ع", "ا و ي ا و", ("", "ن", "ر", "ل", "س")),
    "": ("b d f g h k l m n p r s t v w z", "a e i o u", ("", "n", "r", "l", "s")),
}
#: Endings by script for m and f.
ENDINGS = {"IsCyrillic": ("ин", "ина"), "IsGreek": ("ος", "α"), "IsArabic": ("", "ة"), "": ("in", "a")}
#: The attempt from which numbers get further digits.
GROWS = 12


def kind_of(entity: Column) -> Column:
    return reduce(lambda rest, p: F.when(entity.rlike(f"^(?:{p[1]})$"), F.lit(p[0])).otherwise(rest), reversed(PATTERNS), F.lit("name"))


def name_words(entity: Column) -> Column:
    """The words of a name without its title, initials left out."""
    words = F.split(F.regexp_replace(F.regexp_replace(entity, _TITLE, ""), _HAN_TITLE, ""), " ")
    return F.filter(words, lambda w: ~w.endswith("."))


def name_keys(entity: Column) -> Column:
    """What a name's words are known by: given names by gender (m, f or x), the last word, the surname, as n."""
    female = entity.rlike(rf"^(?:{FEMALE}|{ARABIC_FEMALE})(?!\p{{L}})|{HAN_FEMALE}$")
    male = entity.rlike(rf"^(?:{MALE}|{ARABIC_MALE})(?!\p{{L}})|{HAN_MALE}$")
    gender = F.when(female, "f ").when(male, "m ").otherwise("x ")
    words = name_words(entity)
    return F.transform(words, lambda w, i: F.concat(F.when(i == F.size(words) - 1, F.lit("n ")).otherwise(gender), w))


def canonical(kind: Column, entity: Column) -> Column:
    """What all formats of an entity (but a name) share; for a phone number its country code, a space and the rest."""
    digits = F.regexp_replace(entity, r"\D", "")
    apart = F.regexp_extract(entity, r"^\+(\d{1,3})[ .(-]", 1)
    code = F.when(F.length(apart) > 0, apart).otherwise(F.regexp_extract(digits, COUNTRY, 1))
    phone = F.when(entity.startswith("+"), F.concat(code, F.lit(" "), F.substring(digits, F.length(code) + 1, F.length(digits)))).otherwise(F.concat(F.lit("1 "), digits))
    return F.when(kind == "email", F.lower(entity)).when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "secret", F.regexp_replace(entity, rf"^{SECRET_LABEL}[\"']?[ ]{{0,3}}[:=][ ]{{0,3}}[\"']?", "")).otherwise(entity)


def plain(kind: Column, canon: Column) -> Column:
    """What a surrogate is compared with: for names the word without its mark."""
    return F.when(kind == "name", F.substring(canon, F.lit(3), F.length(canon))).otherwise(canon)


def _number(text: Column, at: Column, below: int) -> Column:
    """A number below ``below`` from two bytes of a hash in hex, at place ``at`` (from 0)."""
    return F.conv(F.substring(text, (at * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") % below


def _hash(key: str, *parts: Column) -> Column:
    one = F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)
    return F.concat(one, F.sha2(F.concat_ws("|", F.lit(key), F.lit("more"), *parts), 256))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: F.length(c) > 0)


def _luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 if the check digit holds."""
    values = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v)


def _pick(items: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), at + 1)


def _syllable(h: Column, starts: str, vowels: str, ends: tuple[str, ...]):
    def made(i: Column) -> Column:
        n = _number(h, i, 400)
        return F.concat(_pick(starts.split(), n % 16), _pick(vowels.split(), F.floor(n / 16).cast("int") % 5), _pick(list(ends), F.floor(n / 80).cast("int")))

    return made


def _invented(word: Column, mark: Column, attempt: Column, h: Column) -> Column:
    """A name of a word's script: two syllables, one more every second attempt, and an ending by gender."""
    made = F.lit("")
    for script, sounds in reversed(SYLLABLES.items()):
        many = F.least(F.lit(1) + F.floor(attempt / 2), F.lit(30)).cast("int")
        body = F.array_join(F.transform(F.sequence(F.lit(0), many), _syllable(h, *sounds)), "")
        m, f = ENDINGS[script]
        # a Cyrillic surname tells the gender by itself; others are the same for all
        female = (mark == "f") | ((mark == "n") & word.rlike("[ая]$")) if script == "IsCyrillic" else mark == "f"
        male = (mark == "m") | ((mark == "n") & ~word.rlike("[ая]$")) if script == "IsCyrillic" else mark == "m"
        whole = F.initcap(F.concat(body, F.when(female, f).when(male, m).otherwise("")))
        made = F.when(word.rlike(rf"^\p{{{script}}}"), whole).otherwise(made) if script else whole
    given = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)) + F.floor(attempt / 2).cast("int")), lambda i: _pick(list(HAN_GIVEN), _number(h, i, len(HAN_GIVEN)))), "")
    han = F.concat(_pick(list(HAN_SURNAMES), _number(h, F.lit(0), len(HAN_SURNAMES))), F.when((F.length(word) == 1) & (attempt < 2), "").otherwise(given))
    return F.when(word.rlike(r"^\p{IsHan}"), han).otherwise(made)


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the surrogate; of a name's word the word."""
    h = _hash(key, kind, canon, attempt.cast("string"))
    letters, n = F.lit("abcdefghijklmnopqrstuvwxyz"), F.length(canon)
    digit = lambda i: _number(h, i % 32, 10).cast("string")
    letter = lambda i: F.substring(letters, _number(h, i % 32, 26) + 1, F.lit(1))
    swap = lambda c, i: F.when(c.rlike("^[0-9]$"), digit(i)).when(c.rlike("^[a-z]$"), letter(i)).when(c.rlike("^[A-Z]$"), F.upper(letter(i))).otherwise(c)
    hexed = lambda c, i: F.when(c.rlike("^[0-9a-f]$"), F.substring(h, (i % 128 + 1).cast("int"), F.lit(1))).otherwise(F.upper(F.substring(h, (i % 128 + 1).cast("int"), F.lit(1))))
    extra = F.when(attempt >= GROWS, F.array_join(F.transform(F.sequence(F.lit(1), attempt - GROWS + 4), lambda i: digit(i * 3)), "")).otherwise("")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    place = _hash(key, F.lit("domain"), domain)
    label = F.concat(F.lit("mail"), F.substring(place, 1, 12))
    # after some attempts a short local part is made longer
    longer = F.when(attempt >= 4, F.concat(F.lit("."), F.substring(h, F.lit(1), F.least(attempt * 2, F.lit(48))))).otherwise("")
    email = F.concat(F.array_join(F.transform(_chars(local), swap), ""), longer, F.lit("@"), label, F.lit(".example."), F.when(domain.rlike(r"\.(com|org|net)$"), F.substring_index(domain, ".", -1)).otherwise("com"))
    # the country code stays; a North American area code starts with 2 to 9, and 555 stays as long as that leaves room
    code, number = F.substring_index(canon, " ", 1), F.substring_index(canon, " ", -1)
    northern = (code == "1") & (F.length(number) == 10)
    kept = (attempt < 4) & (F.substring(number, 4, 3) == "555")
    american = F.array_join(F.transform(_chars(number), lambda c, i: F.when(i == 0, (_number(h, i % 32, 8) + 2).cast("string")).when((i >= 3) & (i < 6) & kept, F.lit("5")).otherwise(digit(i))), "")
    other = F.array_join(F.transform(_chars(number), lambda c, i: F.when(i == 0, c).otherwise(digit(i))), "")
    phone = F.concat(code, F.lit(" "), F.when(northern, american).otherwise(other), extra)
    body = F.array_join(F.transform(_chars(F.substring(canon, F.lit(1), n - 1)), lambda c, i: F.when(i == 0, c).otherwise(digit(i))), "")
    check = (F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    wrong = (_luhn(canon) % 10 != 0).cast("int")
    card = F.concat(body, ((check + wrong * (1 + _number(h, F.lit(31), 9))) % 10).cast("string"), extra)
    # numbers from 900 up are none of real people; with very many entities others are taken
    first = F.when(attempt < 4, F.lit("9")).otherwise(digit(F.lit(20)))
    ssn = F.concat(first, F.array_join(F.transform(_chars(F.substring(canon, F.lit(2), n - 1)), lambda c, i: digit(i)), ""), extra)
    four = F.array_join(F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: (_number(h, i, 254) + 1).cast("string")), ".")
    six = F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(h, (i * 4 + 1).cast("int"), F.lit(4))), ":"))
    ip = F.when(attempt < GROWS, four).otherwise(six)
    known = F.regexp_extract(canon, r"^(?:AKIA|gh[pousr]_|sk[-_]|xox[abprs]-)", 0)
    rest = F.substring(canon, F.length(known) + 1, n)
    secret = F.concat(known, F.array_join(F.when(rest.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.transform(_chars(rest), hexed)).otherwise(F.transform(_chars(rest), swap)), ""), extra)
    name = _invented(plain(kind, canon), F.substring(canon, 1, 1), attempt, h)
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "ip", ip).when(kind == "secret", secret).otherwise(name)


def poured(kind: Column, entity: Column, canon: Column) -> Column:
    """A canonical surrogate in the format of an entity that isn't a name; digits for which it has no place come last."""
    chars = _chars(entity)
    slots = F.length(F.regexp_replace(entity, r"\D", ""))
    source = F.when(kind == "phone", F.when(entity.startswith("+"), F.replace(canon, F.lit(" "), F.lit(""))).otherwise(F.substring_index(canon, " ", -1))).otherwise(canon)
    before = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), r"\D", ""))
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(source, before(i) + 1, F.lit(1))).otherwise(c)), "")
    digits = F.concat(digits, F.substring(source, slots + 1, F.length(source)))
    upper = F.when(F.upper(entity) == entity, F.upper(canon)).otherwise(canon)
    label = F.regexp_extract(entity, rf"^{SECRET_LABEL}[\"']?[ ]{{0,3}}[:=][ ]{{0,3}}[\"']?", 0)
    return F.when(kind == "email", upper).when(kind.isin("phone", "card", "ssn"), digits).when(kind == "secret", F.concat(label, canon)).otherwise(canon)


def assign(entities: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """entities (kind, canon), distinct, to (kind, canon, other): the surrogates, distinct within a type and none of them an entity."""
    real = entities.select("kind", plain(F.col("kind"), F.col("canon")).alias("other")).distinct()
    made = None
    todo = entities.withColumn("attempt", F.lit(0))
    for r in range(rounds):
        tried = todo.withColumn("other", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        tried = tried.join(real.withColumn("is_real", F.lit(True)), ["kind", "other"], "left")
        if made is not None:
            tried = tried.join(made.select("kind", "other", F.lit(True).alias("is_made")), ["kind", "other"], "left")
        else:
            tried = tried.withColumn("is_made", F.lit(None).cast("boolean"))
        first = tried.filter("is_real IS NULL AND is_made IS NULL").groupBy("kind", "other").agg(F.min("canon").alias("canon"))
        first = keep(first.select("kind", "canon", "other"), "surrogates")
        made = first if made is None else made.unionByName(first)
        todo = keep(todo.join(first, ["kind", "canon"], "left_anti").withColumn("attempt", F.lit(r + 1)), "collisions")
        if not todo.limit(1).count():
            return made
    raise RuntimeError("surrogates grow with the attempts, and still some were not distinct")


def _mended(piece: Column, pairs: Column) -> Column:
    """A stretch of text between entities, the words of ``pairs`` (word, other; longest first) replaced where they stand alone."""
    one = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.transform(pairs, lambda p: p["word"]), "|"), F.lit(r")(?!\p{L})"))
    other = lambda w: F.element_at(F.filter(pairs, lambda p: p["word"] == w), 1)["other"]
    hits = F.transform(F.regexp_extract_all(piece, one, F.lit(0)), other)
    return F.array_join(F.zip_with(F.split(piece, one, -1), hits, lambda rest, hit: F.concat(rest, F.coalesce(hit, F.lit("")))), "")


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = "key", into: str = "entities") -> DataFrame:
    """docs with the personal data in text_col replaced, and a column ``into``: how many entities were (names alone not counted).

    Null texts stay null with 0 entities; empty ones and those without personal data stay as they are; repeated rows get equal
    results; whole texts are searched, in time that grows with their length. An empty table gives an empty one. A column of docs
    that is named like ``into`` stays, under its name with underscores added until it is free. The same key gives the same
    surrogates over the same corpus.
    """
    names = free_names(docs.columns, [into])
    text = F.col(f"`{text_col}`")
    digest = F.unhex(F.sha2(text, 256))
    # every pattern but a name's has a digit or an @, and all patterns are looked for only in texts that have one or a name
    maybe = text.rlike("[0-9@]") | text.rlike(NAME)
    found = docs.select(text.alias("text")).filter(maybe).withColumn("found", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).filter(F.size("found") > 0)
    found = found.select(F.unhex(F.sha2("text", 256)).alias("digest"), "found", F.split("text", PATTERN, -1).alias("rest"))
    found = keep(found.groupBy("digest").agg(F.first("found").alias("found"), F.first("rest").alias("rest")), "found")
    mentions = found.select("digest", F.posexplode("found").alias("at", "entity"))
    entities = mentions.groupBy("entity").agg(F.count("*").alias("n")).withColumn("kind", kind_of(F.col("entity")))
    entities = keep(entities.withColumn("canon", F.when(F.col("kind") == "name", name_keys(F.col("entity"))).otherwise(F.array(canonical(F.col("kind"), F.col("entity"))))), "entities")
    parts = entities.select("kind", "entity", F.posexplode("canon").alias("at", "canon"))
    others = assign(parts.select("kind", "canon").distinct(), key)
    made = parts.join(others, ["kind", "canon"]).groupBy("kind", "entity").agg(F.array_sort(F.collect_list(F.struct("at", "other"))).alias("made"))
    made = made.withColumn("made", F.transform("made", lambda m: m["other"]))
    entity, kind = F.col("entity"), F.col("kind")
    title, after = F.regexp_extract(entity, _TITLE, 0), F.regexp_extract(entity, _HAN_TITLE, 0)
    named = F.concat(title, F.array_join("made", " "), after)
    pairs = F.filter(F.arrays_zip(name_words(entity).alias("word"), F.col("made").alias("other")), lambda p: p["word"].rlike(r"^\p{Lu}\p{L}"))
    replaced = made.select("entity", F.when(kind == "name", named).otherwise(poured(kind, entity, F.element_at("made", 1))).alias("other"), F.when(kind == "name", pairs).alias("pairs"))
    replaced = keep(replaced, "replaced")
    lists = mentions.join(replaced, "entity").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("at", "other"))).alias("new"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    longest = F.transform(F.array_sort(F.transform("pairs", lambda p: F.struct((-F.length(p["word"])).alias("less"), p["word"].alias("word"), p["other"].alias("other")))), lambda p: F.struct(p["word"].alias("word"), p["other"].alias("other")))
    texts = lists.withColumn("pairs", longest).join(found.select("digest", "rest"), "digest")
    rest = F.when(F.size("pairs") > 0, F.transform("rest", lambda piece: _mended(piece, F.col("pairs")))).otherwise(F.col("rest"))
    whole = F.array_join(F.zip_with(rest, F.transform("new", lambda s: s["other"]), lambda piece, other: F.concat(piece, F.coalesce(other, F.lit("")))), "")
    # written, so that the join below has two plain sides and Spark can split the copies of one text over tasks
    texts = keep(texts.select("digest", F.size("new").alias("n"), whole.alias("text")), "replaced_texts")
    rows = docs.select(digest.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(texts, rows["key"] == texts["digest"], "left")
    columns = [(F.coalesce(texts["text"], F.col("row").getField(c)) if c == text_col else F.col("row").getField(c)).alias(n) for c, n in names.items()]
    return out.select(*columns, F.coalesce("n", F.lit(0)).alias(into))
