"""Surrogates for personal data, with DataFrame functions alone.

Entities of whole texts are found by one pattern, brought to a canonical form, and counted over
the corpus. Each distinct entity gets one surrogate of its own type, drawn by a keyed hash:
digits stay digits in their places, letters letters of the same script and case, given names
made names with an ending of the same gender, account numbers ones with right check digits, mail addresses of one domain addresses of one domain, private network
addresses private. A person's name is a title, given names and a family name with a surrogate
each, so that "Frau Schmidt" and "Anna Schmidt" still share theirs; a telephone number is its national
part, so that spellings with and without the country agree. The table of entities is then
checked: a surrogate that is also a real entity, or that two entities drew, is drawn again with
the next number, from a wider set after many, until none is left. The same entity therefore has
the same surrogate everywhere, and two entities never share one. Texts are put together again
from what stands between entities.

Names are found by titles, by what introduces a name, by honorifics after them and by given
names of a list. A name with none of these around it is not told from other capitalised words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloam.llm.common import BROADCAST_ROWS, LOWER, UPPER, join_salted, settle, shield
from graphloam.session import dealt

# Given names by gender and script, in natural order.
FEMALE = "Alice Amelia Anna Clara Elena Emma Greta Hannah Ines Julia Laura Lea Lucia Maria Marie Nina Nora Olivia Paula Rosa Sara Sofia Sophie Teresa".split()
MALE = "Adam Alexander Carlos Daniel David Diego Felix Hans Henri James Jan John Jonas Julien Karl Lucas Luis Martin Oscar Paul Peter Robert Thomas Victor".split()
FEMALE_CYRILLIC = "Анна Вера Дарья Елена Ирина Мария Нина Ольга Полина Татьяна".split()
MALE_CYRILLIC = "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split()
FEMALE_TITLES = "Frau Madame Miss Mlle Mme Mrs Ms Señora Sra г-жа госпожа Госпожа".split()
MALE_TITLES = "Herr Monsieur Mr Señor Sr г-н господин Господин".split()
OTHER_TITLES = "Doctor Dr Prof Professor доктор Доктор профессор Профессор".split()
#: What introduces a name, in scripts with capitals and in those without.
CUES = ("name is ", "name: ", "Name: ", "Name ist ", "m'appelle ", "me llamo ", "Nombre: ", "Nom : ", "зовут ", "Имя: ", "Sincerely, ", "Regards, ", "signed by ")
CUES_WITHOUT_CASE = ("Name: ", "name: ", "姓名：", "姓名: ", "이름: ", "الاسم: ", "नाम: ", "שם: ")
#: Letters that surrogates are drawn from in other scripts: the script and some of its letters.
ALPHABETS = (("Greek", "αβγδεζηθικλμνξοπρστυφχψω"), ("Arabic", "ابتثجحخدرزسشصطعفقكلمنهوي"), ("Hebrew", "אבגדהוזחטיכלמנסעפצקרשת"), ("Devanagari", "कखगघचछजटडतथदधनपफबभमयरलवसह"), ("Han", "丁丘乙于元兆光冬北升南吉向夏"), ("Hangul", "가나다라마바사아자차카타파하"))
CYRILLIC_LETTERS = "абвгдежзиклмнопрстуфхцчшэюя"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"



def _one_of(words: list[str]) -> str:
    """A pattern for one of the words: those of one first letter are tried only where that letter stands. What follows must end the word."""
    rests: dict[str, list[str]] = {}
    for word in words:
        rests.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{first}(?:{'|'.join(more)})" for first, more in rests.items())


_TITLED = rf"(?:(?:{_one_of(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)})\.? ){{1,3}}"
#: A capitalised word of any length, with what stands before a second capital in family names, and a second part after a hyphen.
_WORD = r"(?:\p{Lu}['’]|Mc|Mac)?\p{Lu}[\p{Ll}\p{M}'’]++(?:-\p{Lu}\p{Ll}++)?"
_PLAIN_WORD = r"[\p{Lo}\p{M}]{2,20}"
_BEHIND_CUE = "|".join(f"(?<={cue})" for cue in CUES)  # each of one length: no other is tried
_CAPITAL_NAME = rf"(?=[\p{{Lu}}гдп])(?<![\p{{L}}\p{{N}}])(?:{_TITLED}{_WORD}(?: {_WORD})?|(?:{_one_of(FEMALE + MALE + FEMALE_CYRILLIC + MALE_CYRILLIC)}) {_WORD}|(?:{_BEHIND_CUE}){_WORD}(?: {_WORD}){{0,2}})(?![\p{{L}}\p{{N}}])"
#: Looking up a script is slow and no letter of Han or Hangul comes before U+1100.
_NAME = (
    rf"{_CAPITAL_NAME}"
    rf"|(?=\p{{Lo}})(?<=(?:{'|'.join(CUES_WITHOUT_CASE)})){_PLAIN_WORD}(?: {_PLAIN_WORD}){{0,2}}"
    r"|(?![\x00-\u10FF])(?<![\p{IsHan}\p{IsHangul}])[\p{IsHan}\p{IsHangul}]{1,6}?(?=様|さん|氏|씨)"
)

#: Type, pattern; the first that matches at a place decides.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,127}+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?![\d\-])"),
    ("ip", rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?![\d]|\.\d)"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?\(?\d{2,4}\)?[ .\-]\d{3,4}[ .\-]\d{3,4}(?![\w])|(?<![\w+])\+\d{8,15}(?!\w)"),
    ("name", _NAME),
)
_OF = dict(PATTERNS)
#: The same without mail addresses: at each place only the types that can begin with its character are tried, in that order.
PATTERN_WITHOUT_MAIL = (
    r"(?=[A-Z0-9+(\x80-\x{10FFFF}])(?:"
    rf"(?=[A-Z])(?:{_OF['iban']}|{_CAPITAL_NAME})"
    rf"|(?=[0-9+(])(?:{'|'.join(_OF[k] for k in ('ssn', 'card', 'ip', 'phone'))})"
    rf"|(?![\x00-\x7F])(?:{_NAME}))"
)
PATTERN = f"(?=[A-Za-z0-9])(?:{_OF['email']})|{PATTERN_WITHOUT_MAIL}"


def by_pattern(text: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use(text, pattern)`` with all types; texts without an @ are not searched for mail addresses, which begin at any word."""
    return F.when(text.contains("@"), use(text, F.lit(PATTERN))).otherwise(use(text, F.lit(PATTERN_WITHOUT_MAIL)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row: inside a lambda, Spark computes a column each time it is named."""
    return F.transform(F.array(value), use)[0]


def kind_of(entity: Column) -> Column:
    """The type of an entity that PATTERN has found."""
    out = F.lit("name")
    for name, pattern in reversed(PATTERNS[:-1]):
        # the places around it are not there any more, so only the shape is tested
        shape = pattern.replace(r"(?<![\d\-])", "").replace(r"(?<![\d.\-])", "").replace(r"(?<![\d.])", "").replace(r"(?<![A-Za-z0-9])", "").replace(r"(?<![\w+])", "")
        out = F.when(entity.rlike(f"^(?:{shape})$"), name).otherwise(out)
    return out


#: A country code after its plus sign (fixed values: those of one and two digits; all others have three), and a trunk zero.
_COUNTRY = r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}))?0?"


def canonical(entity: Column, kind: Column) -> Column:
    """The form under which spellings of one entity are the same: numbers without punctuation, addresses in lower case, telephones without country and trunk zero."""
    bare = F.regexp_replace(entity, r"[^0-9A-Za-z]", "")
    phone = F.regexp_replace(F.regexp_replace(entity, r"[^0-9+]", ""), _COUNTRY, "")
    return F.when(kind == "email", F.lower(entity)).when(kind.isin("card", "iban", "ssn"), bare).when(kind == "phone", phone).otherwise(entity)


def _title(name: Column) -> Column:
    return F.regexp_extract(name, f"^({_TITLED})", 1)


def parts_of(entity: Column, kind: Column) -> Column:
    """What of an entity gets surrogates: array of kind, canon and gender (1 female, 2 male, 0 not known); of a name, given names and the family name."""
    listed = lambda w: F.when(w.isin(*FEMALE, *FEMALE_CYRILLIC), 1).when(w.isin(*MALE, *MALE_CYRILLIC), 2).otherwise(0)
    part = lambda k, c, g: F.struct(k.alias("kind"), c.alias("canon"), g.cast("int").alias("gender"))

    def named(title: Column) -> Column:
        titled = F.when(title.rlike(f"(?:^| )(?:{'|'.join(FEMALE_TITLES)})\\.? "), 1).when(title.rlike(f"(?:^| )(?:{'|'.join(MALE_TITLES)})\\.? "), 2).otherwise(0)
        last = lambda w, i, n: (i == n - 1) & ~((n == 1) & (title == "") & (listed(w) > 0))
        each = lambda w, i, n: part(F.when(last(w, i, n), "family").otherwise("given"), w, F.when(last(w, i, n), 0).when(listed(w) > 0, listed(w)).otherwise(titled))
        return _let(F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " "), lambda words: F.transform(words, lambda w, i: each(w, i, F.size(words))))

    return F.when(kind == "name", _let(_title(entity), named)).otherwise(F.array(part(kind, canonical(entity, kind), F.lit(0))))


def _draw(canon: Column, key: str, attempt: Column) -> Column:
    """64 hex digits that the key, the entity and the attempt decide."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), canon, attempt.cast("string")), 256)


def _stretch(digest: Column) -> Column:
    """Hex digits for entities of any length that the patterns allow (320 characters and less)."""
    return F.concat(digest, *[F.sha2(F.concat(digest, F.lit(str(i))), 256) for i in range(5)])


def _shape(text: Column, digest: Column) -> Column:
    """``text`` with every ASCII digit, small and capital letter drawn anew; all else stays."""
    chars = F.split(text, "")
    value = lambda d, i: F.conv(F.substring(d, i % 190 * 2 + 1, 4), 16, 10).cast("int")
    drawn = lambda d, c, i: F.when(c.rlike("[0-9]"), F.substring(F.lit("0123456789"), value(d, i) % 10 + 1, F.lit(1))).when(c.rlike("[a-z]"), F.substring(F.lit(LOWER), value(d, i) % 26 + 1, F.lit(1))).when(c.rlike("[A-Z]"), F.substring(F.lit(UPPER), value(d, i) % 26 + 1, F.lit(1))).otherwise(c)
    return _let(digest, lambda d: F.array_join(F.transform(chars, lambda c, i: drawn(d, c, i)), ""))


def _pick(names: list[str], digest: Column, at: int) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.conv(F.substring(digest, at, 6), 16, 10).cast("int") % len(names) + 1).cast("int"))


def _letters(alphabet: str, digest: Column, length: Column) -> Column:
    """``length`` letters of an alphabet, drawn by the digest."""
    value = lambda i: F.conv(F.substring(F.sha2(F.concat(digest, i.cast("string")), 256), 1, 6), 16, 10).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(F.lit(alphabet), value(i) % len(alphabet) + 1, F.lit(1))), "")


def _family(word: Column, digest: Column, attempt: Column) -> Column:
    """A word of the same script and about the same length, with a capital if it had one."""
    length = F.least(F.greatest(F.length(word), F.lit(2)), F.lit(12)) + F.floor(attempt / 4).cast("int")
    made = F.initcap(_letters(LOWER, digest, F.greatest(length, F.lit(5))))
    for script, letters in (*ALPHABETS, ("Cyrillic", CYRILLIC_LETTERS)):
        made = F.when(word.rlike(rf"\p{{Is{script}}}"), F.initcap(_letters(letters, digest, length))).otherwise(made)
    return made


#: What surrogates of given names are made of, by script: consonants, vowels, and endings of female and male names.
SYLLABLES = {
    "Latin": ("bdfglmnprstvz", "aeiou", ("ala", "ara", "elia", "ena", "etta", "ina", "isa", "ora"), ("ald", "ard", "emir", "eno", "ic", "imar", "olf", "os")),
    "Cyrillic": ("бвгдзлмнпрст", "аеиоу", ("алия", "ана", "елла", "ина", "ора", "уся"), ("ан", "ар", "ег", "им", "ислав", "ор")),
}


def _given(word: Column, gender: Column, digest: Column, attempt: Column) -> Column:
    """A made given name of the same script, with an ending of the same gender, where that is known.

    Names are two syllables and an ending, and one syllable more for every two draws, so there are enough for
    any number of entities, whichever names the texts hold.
    """
    value = lambda i: F.conv(F.substring(F.sha2(F.concat(digest, F.lit("given"), i.cast("string")), 256), 1, 6), 16, 10).cast("int")
    one = lambda letters, n: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
    out = _family(word, digest, attempt)
    for script, (consonants, vowels, female, male) in SYLLABLES.items():
        pairs = F.transform(F.sequence(F.lit(1), F.lit(1) + F.floor(attempt / 2).cast("int")), lambda i: F.concat(one(consonants, value(i * 3)), one(vowels, value(i * 3 + 1))))  # noqa: B023
        end = F.when(gender == 1, _pick(list(female), digest, 1)).when(gender == 2, _pick(list(male), digest, 1)).otherwise(_pick([*female, *male], digest, 1))
        out = F.when(word.rlike(rf"\p{{Is{script}}}"), F.initcap(F.concat(F.array_join(pairs, ""), one(consonants, value(F.lit(2))), end))).otherwise(out)
    return out


def _octets(canon: Column, digest: Column, attempt: Column) -> Column:
    """Private, loopback and link-local addresses stay in their ranges while these have room; all others are drawn from 11 to 126."""
    at = F.split(canon, r"\.")
    drawn = lambda i: (F.conv(F.substring(digest, i * 4 + 1, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    first, second = at[0].cast("int"), at[1].cast("int")
    two = ((first == 192) & (second == 168)) | ((first == 172) & second.between(16, 31)) | ((first == 169) & (second == 254))
    inside = F.when(two & (attempt < 20), F.array(at[0], at[1], drawn(2), drawn(3))).when(first.isin(10, 127) & (attempt < 20), F.array(at[0], drawn(1), drawn(2), drawn(3)))
    public = F.array((F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % 116 + 11).cast("string"), drawn(1), drawn(2), drawn(3))
    return F.array_join(F.coalesce(inside, public), ".")


def _email(canon: Column, key: str, digest: Column, attempt: Column) -> Column:
    """A drawn local part of the same shape in a reserved domain with the same number of labels.

    The domain follows from the real one alone, so addresses of one domain stay together. Each
    new draw adds letters to the local part, so there are enough however short they are.
    """
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host = F.concat(F.lit("h"), F.substring(_draw(F.concat(F.lit("host:"), domain), key, F.lit(0)), 1, 16))
    more = F.when(attempt > 0, _letters(LOWER, digest, attempt)).otherwise("")
    return F.concat(_shape(local, _stretch(digest)), more, F.lit("@"), host, F.when(F.size(F.split(domain, r"\.")) > 2, ".example.invalid").otherwise(".invalid"))


def _luhn(digits: Column) -> Column:
    """Digits with the last one set so that the checksum of card numbers is right."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    total = lambda body: F.aggregate(F.transform(F.reverse(F.split(body, "")), value), F.lit(0), lambda s, v: s + v)
    return _let(digits, lambda d: _let(F.substring(d, F.lit(1), F.length(d) - 1), lambda body: F.concat(body, (F.pmod(10 - total(body) % 10, F.lit(10))).cast("string"))))


def _checked(iban: Column) -> Column:
    """An account number with the two check digits that leave a remainder of 1 by 97."""
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)

    def checked(given: Column) -> Column:
        country, body = F.substring(given, 1, 2), F.substring(given, 5, 400)
        rest = F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise((s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit(c)) % 97))
        return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)

    return _let(iban, checked)


#: Draws in the usual range of a kind, and draws of the usual length; later ones are wider.
NEAR, PLAIN = 20, 60


def surrogate(kind: Column, canon: Column, gender: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a part of an entity in canonical form."""
    # country codes and the first digit of cards say what an entity is; they stay
    behind = lambda shaped, n, head: F.concat(head, F.substring(shaped, n + 1, 400))

    def number(digest: Column) -> Column:
        shaped = _shape(canon, _stretch(digest))
        out = (
            F.when(kind == "ip", _octets(canon, digest, attempt))
            .when(kind == "card", _luhn(behind(shaped, 1, F.substring(canon, 1, 1))))
            .when(kind == "iban", _checked(behind(shaped, 2, F.substring(canon, 1, 2))))
            .when((kind == "phone") & (F.length(canon) >= 10) & (attempt < NEAR), behind(shaped, 1, F.substring(canon, 1, 1)))
            .when((kind == "ssn") & (attempt < NEAR), behind(shaped, 1, F.lit("9")))
            .otherwise(shaped)
        )
        return F.when(attempt < PLAIN, out).otherwise(F.concat(out, _letters(LOWER, digest, F.greatest(attempt - PLAIN + 1, F.lit(1)))))

    made = lambda digest: F.when(kind == "email", _email(canon, key, digest, attempt)).when(kind == "given", _given(canon, gender, digest, attempt)).when(kind == "family", _family(canon, digest, attempt)).otherwise(number(digest))
    return _let(_draw(F.concat_ws(":", kind, canon), key, attempt), made)


#: Entities that make a task worth its files: each takes many times the work of its few bytes.
TASK_ENTITIES = 1000


def _spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of ``rows`` entities dealt by ``keys`` over all cores: by their bytes, a few tasks would get them all."""
    return dealt(df, rows, *keys) if rows > TASK_ENTITIES else df


def surrogate_table(entities: DataFrame, key: str, most_draws: int = 500) -> DataFrame:
    """kind, canon, surrogate for each distinct (kind, canon) of ``entities`` (kind, canon, gender), free of collisions.

    A drawn surrogate is accepted if it is no real entity of its kind, no accepted surrogate,
    and the first of its draw (by entity). The others draw again; they get fewer each time, and
    draws widen, so there are enough for any number of entities. A gender that is known
    anywhere holds everywhere.
    """
    real = settle(entities.groupBy("kind", "canon").agg(F.max("gender").alias("gender")))
    taken, left, accepted, rows = None, real, None, real.count()
    for attempt in range(most_draws):
        drawn = settle(_spread(left, rows, "kind", "canon").withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("gender"), key, F.lit(attempt))))
        free = drawn.join(real.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "surrogate"], "left_anti")
        won = settle(free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"))
        accepted = won if accepted is None else accepted.unionByName(won)
        taken = accepted.select("kind", "surrogate")
        left = settle(left.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        rows = left.count()
        if rows == 0:
            return settle(accepted)
        if attempt % 16 == 15:  # many unions make long plans
            accepted = settle(accepted)
            taken = accepted.select("kind", "surrogate")
    raise RuntimeError(f"no surrogates left after {most_draws} draws")


def _respell(kind: Column, entity: Column, made: Column) -> Column:
    """A surrogate in the spelling of the entity: punctuation stays where it was, and the country and trunk of a telephone too."""
    bare = F.regexp_replace(entity, r"[^0-9A-Za-z]", "")
    kept = F.when(kind == "phone", F.length(bare) - F.length(canonical(entity, kind))).otherwise(F.lit(0))
    chars = F.split(entity, "")
    before = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), r"[^0-9A-Za-z]", ""))
    spelled = lambda full: F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(full, before(i) + 1, F.lit(1))).otherwise(c)), "")
    return F.when(kind.isin("card", "iban", "ssn", "phone"), _let(F.concat(F.substring(bare, F.lit(1), kept), made), lambda full: F.concat(spelled(full), F.substring(full, F.length(bare) + 1, F.lit(400))))).otherwise(made)


def replaced(each: DataFrame, rows: int, key: str) -> DataFrame:
    """_of, _xs: for each text of ``each`` (_h, at, entity; so many ``rows``) its entities in order, with their surrogates; settled."""
    each = _spread(each, rows, "_h", "at").withColumn("kind", kind_of(F.col("entity"))).withColumn("_parts", parts_of(F.col("entity"), F.col("kind")))
    parts = settle(each.select("_h", "at", "kind", "entity", F.posexplode("_parts").alias("_i", "_part")))
    made = surrogate_table(parts.select("_part.*"), key)
    name = lambda k, c: F.concat_ws("\x1f", k, c)
    made = settle(made.select(name("kind", "canon").alias("_entity"), "surrogate"))
    spelled = join_salted(parts.withColumn("_key", name("_part.kind", "_part.canon")), made, "_key", "_entity", F.xxhash64("_h", "at"), 8)
    whole = _spread(spelled, rows, "_h", "at").groupBy("_h", "at").agg(F.first("kind").alias("kind"), F.first("entity").alias("entity"), F.sort_array(F.collect_list(F.struct("_i", "surrogate"))).alias("_made"))  # as many as a name has words
    words = F.array_join(F.transform("_made", lambda x: x["surrogate"]), " ")
    text = F.when(F.col("kind") == "name", F.concat(_title(F.col("entity")), words)).otherwise(_respell(F.col("kind"), F.col("entity"), words))
    return settle(whole.groupBy(F.col("_h").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("at", "kind", "entity", text.alias("surrogate")))).alias("_xs")))


#: Texts with entities whose hashes are broadcast, at some 60 bytes each.
KEYS = 500_000


def parted(given: DataFrame, lists: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``given`` whose texts have one of the ``rows`` ``lists``, and the others; one without any that shares a hash may be among the first.

    Hashes are looked up, as searching every text twice again costs several times that; of more than KEYS texts they
    would be too large for each task, and the texts are searched.
    """
    if rows <= KEYS:
        keys, match = F.broadcast(lists.select(F.xxhash64("_of").alias("_key"))), F.xxhash64("_h") == F.col("_key")
        return given.join(keys, match, "left_semi"), given.join(keys, match, "left_anti")
    has = F.coalesce(by_pattern(F.col("text"), lambda t, p: F.rlike(t, p)), F.lit(False))
    return given.filter(has), given.filter(~has)


def replace_entities(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """Add clean_text and entities (array of kind, entity, surrogate in text order) to the rows of ``docs``.

    A null text stays null and has no entities; texts of any length go whole. Equal texts get
    equal results. Columns of the same names as the added ones are replaced. An entity that
    is spelled in several ways has one surrogate, spelled each time as the entity was. Nothing is
    shuffled but entities, unless so many texts have some that their lists are not broadcast.
    """
    inner, restore = shield(docs, ("text",))
    given = inner.withColumn("_h", F.unhex(F.md5("text")))
    found = given.select("_h", by_pattern(F.col("text"), lambda t, p: F.regexp_extract_all(t, p, 0)).alias("_e")).filter(F.size("_e") > 0)
    found = settle(found.groupBy("_h").agg(F.first("_e").alias("_e")))
    many = found.agg(F.coalesce(F.sum(F.size("_e")), F.lit(0))).first()[0]
    lists = replaced(found.select("_h", F.posexplode("_e").alias("at", "entity")), many, key)
    size = lists.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("_xs")), F.lit(0)).alias("entities")).first()
    if size["rows"] <= BROADCAST_ROWS and size["entities"] <= 4 * BROADCAST_ROWS:  # some 100 bytes each
        joined = given.join(F.broadcast(lists), F.col("_h") == F.col("_of"), "left")
    else:  # texts without entities stay where they are; of the others, equal ones are dealt to several tasks
        some, none = parted(given, lists, size["rows"])
        met = join_salted(some, lists, "_h", "_of", F.spark_partition_id(), 8, "left")
        joined = met.unionByName(none, allowMissingColumns=True)
    joined_up = lambda between: F.concat(F.element_at(between, 1), F.array_join(F.zip_with(F.transform("_xs", lambda x: x["surrogate"]), F.slice(between, 2, F.size("_xs")), lambda s, t: F.concat(s, t)), ""))
    made_text = _let(by_pattern(F.col("text"), lambda t, p: F.split(t, p, -1)), joined_up)
    kinds = F.transform("_xs", lambda x: F.struct(x["kind"].alias("kind"), x["entity"].alias("entity"), x["surrogate"].alias("surrogate")))
    empty = F.array().cast("array<struct<kind:string,entity:string,surrogate:string>>")
    out = joined.withColumns({"clean_text": F.when(F.col("_xs").isNull(), F.col("text")).otherwise(made_text), "entities": F.coalesce(kinds, empty)})
    return restore(out, "clean_text", "entities")


def digest(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """doc_id, the number of entities, their kinds, and the text with surrogates."""
    out = replace_entities(docs.select("doc_id", "text"), key)
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda x: x["kind"]))), ",").alias("kinds"), F.col("clean_text").alias("text"))
