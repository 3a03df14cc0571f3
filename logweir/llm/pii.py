"""Operator 8: surrogates for personal data.

Detected entities are replaced by keyed surrogates of their type and format. A surrogate is a
function of the secret key, the entity's type and its canonical form (digits only, or lower
case), so every mention of an entity, however it is written, gets the same surrogate, set in
the mention's own separators and case. Given and family names have surrogates apart, so a
surname agrees with the full name, and where a text names someone with a title, later bare
mentions of the name are replaced as well; telephone numbers go by their last ten digits.

Names are made from syllables of the name's script: given names with endings of the gender that
the title tells (after Dr, Prof and the like, that the name's own ending suggests), family names
with endings of their own. Distinct entities keep distinct surrogates: all surrogates of the
corpus are checked against each other and against the originals, and those that collide are
drawn again under the next attempt number, from a larger space, until none is left.

Types: e-mail addresses; telephone numbers (country codes stay; also ten plain digits in the
North American form); IPv4 addresses; payment cards that pass the Luhn check and IBANs that pass
theirs (so do their surrogates; other long numbers stay); social security numbers (undashed ones
after their name); names after a title (title and initials stay); quoted secrets assigned to a
name such as token or password.

Only DataFrame functions run. Defined cases: a null text stays null and an empty one empty;
repeated rows get the same text; an empty table gives an empty table; other columns, whatever
their names, are kept by ``pseudonymise``. Columns starting with ``__`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import checkpointed, let, table

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Titles by the gender they tell.
_MALE = "Mr|Herr|Monsieur|Señor|Sr|[Гг]-н|[Гг]осподин|[Κκ]ύριος"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Srta|Sra|[Гг]-жа|[Гг]оспожа|[Κκ]υρία"
_TITLE = f"(?:{_FEMALE}|{_MALE}|Dr|Professor|Prof)"
#: Endings of given names that suggest a woman's, where the title doesn't tell.
_FEMALE_ENDING = "[aeаяαη]$"
#: A word of a name: capitalised, also inside as in O'Brien, McDonald and Anne-Marie.
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:[-'’]?\p{Lu}\p{Ll}+)*"
#: What stands before a name and stays.
_FRAME = rf"{_TITLE}\.? (?:\p{{Lu}}\. ){{0,2}}"
#: Types by precedence; an entity belongs to the first pattern that matches all of it.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"""(?i:(?<![\p{L}\p{N}])(?:token|secret|password|passwd|pwd|(?:api|access|private)_?key)["']?\s*[=:]\s*(?:"[^"\s]{8,}"|'[^'\s]{8,}'))""",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<!\p{L})(?i:SSN|social security(?: number| no\.?)?)\s{0,2}[:#=]?\s{0,2}\d{3} ?\d{2} ?\d{4}(?!\d)",
    "iban": r"(?<![\p{L}\p{N}])\p{Lu}{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)|(?<![\d.,-])[2-9]\d{2}[2-9]\d{6}(?![.,-]?\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)",
    "name": rf"(?<!\p{{L}}){_FRAME}{_NAME}(?: {_NAME})?",
}
ANY = "|".join(PATTERNS.values())
#: A cheap test that every text with an entity passes, so that most texts skip the patterns.
HINT = rf"""@|\d[\d. ()-]{{5,}}\d|"[^"\s]{{8,}}"|'[^'\s]{{8,}}'|{_TITLE}\.? \p{{Lu}}"""
TYPES = tuple(PATTERNS)
DIGIT_TYPES = ("ssn", "phone", "card")
#: Digits of a national telephone number, at most.
NATIONAL = 10
#: Attempts after which surrogates without syllables get one more character.
LONGER = 8

#: Parts of names by script: syllables are a consonant and a vowel; endings of women's and men's
#: given names and of family names.
NAMES = (
    (r"\p{IsCyrillic}", "б в г д з к л м н п р с т бр др кр", "а е и о у", "а ина ея ия", "ан ей ий ор", "ин ич ко ов ский"),
    (r"\p{IsGreek}", "β γ δ ζ θ κ λ μ ν π ρ σ τ βρ δρ κρ", "α ε ι ο ου", "α ινα η ια", "ας ης ος ων", "ακης ιδης ου πουλος"),
    (r".", "b d f g h k l m n p r s t v br dr kl st tr", "a e i o u", "a elle ia ina", "an er io us", "ard berg er ini man son"),
)

#: Letters by script, lower case, from which surrogate letters of secrets and addresses are drawn.
SCRIPTS = (
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{IsLatin}", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum of a digit string; ``doubled`` is the parity, from the right, of doubled digits."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    values = F.transform(F.split(F.reverse(digits), ""), worth)
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v)


def _iban_check(raw: Column) -> Column:
    """The remainder by 97 of an IBAN with its first four characters moved to the end; 1 is right."""
    plain = F.replace(raw, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        digit = F.rlike(c, F.lit(r"^\d$"))
        return F.when(digit, (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def kind_of(raw: Column) -> Column:
    """The type of a matched string; null for a long number or IBAN that fails its check."""
    out = F.lit(None).cast("string")
    for name in reversed(TYPES):
        whole = F.rlike(raw, F.lit(f"^(?:{PATTERNS[name]})$"))
        if name == "card":
            whole = whole & (_luhn_sum(_digits(raw), 1) % 10 == 0)
        if name == "iban":
            whole = whole & (_iban_check(raw) == 1)
        out = F.when(whole, F.lit(name)).otherwise(out)
    return out


def canonical(kind: Column, raw: Column) -> Column:
    """What stays the same between two mentions of an entity."""
    return (
        F.when(kind == "phone", F.right(_digits(raw), F.lit(NATIONAL)))
        .when(kind.isin(*DIGIT_TYPES), _digits(raw))
        .when(kind == "secret", F.regexp_extract(raw, """^[^=:]*[=:]\\s*["'](.*).$""", 1))
        .when(kind == "name", F.regexp_extract(raw, rf"^{_FRAME}(.*)$", 1))
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
        .otherwise(F.lower(raw))
    )


def units(kind: Column, raw: Column, canon: Column) -> Column:
    """(kind, canon) of the parts of an entity that have surrogates of their own: each word of a name, else the whole."""
    part = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    title = lambda names: F.rlike(raw, F.lit(rf"^(?:{names})\b\.? "))
    suggested = F.rlike(F.element_at(F.split(canon, " "), 1), F.lit(_FEMALE_ENDING))
    female = title(_FEMALE) | (~title(_MALE) & suggested)
    given = F.when(female, F.lit("given_f")).otherwise(F.lit("given_m"))
    of_name = F.transform(F.split(canon, " "), lambda w, i: part(F.when(i < F.size(F.split(canon, " ")) - 1, given).otherwise(F.lit("family")), w))
    return F.when(kind == "name", of_name).otherwise(F.array(part(kind, canon)))


def entities(text: Column) -> Column:
    """Array of (raw, kind, canon) of a text, in order."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    typed = F.transform(found, lambda r: F.struct(r.alias("raw"), kind_of(r).alias("kind")))
    return F.transform(
        typed, lambda e: F.struct(e["raw"], e["kind"], canonical(e["kind"], e["raw"]).alias("canon"))
    )


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical surrogate of a unit of an entity."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"))
    stream = F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(2)])

    def made(s: Column) -> Column:
        value = lambda i: F.conv(F.substring(s, 1, 128).substr(2 * (i % 64) + 1, F.lit(2)), 16, 10).cast("int")
        digit = lambda i: (value(i) % 10).cast("string")
        of = lambda i, parts: F.get(F.array(*[F.lit(x) for x in parts.split()]), value(i) % len(parts.split()))
        # Where a space turns out short, further attempts draw from longer forms.
        drawn_as = F.concat(canon, F.repeat(F.right(canon, F.lit(1)), F.floor(attempt / LONGER).cast("int")))
        chars = F.filter(F.split(drawn_as, ""), lambda c: c != "")

        def name(consonants: str, vowels: str, *endings: str) -> Column:
            syllables = F.transform(F.sequence(F.lit(1), 2 + attempt), lambda i: F.concat(of(3 * i, consonants), of(3 * i + 1, vowels)))
            ends = [of(F.lit(2), e) for e in endings]
            end = F.when(kind == "given_f", ends[0]).when(kind == "given_m", ends[1]).otherwise(ends[2])
            return F.initcap(F.concat(F.array_join(syllables, ""), of(F.lit(0), consonants), end))

        named = F.lit(None).cast("string")
        for pattern, *parts in reversed(NAMES):
            named = F.when(F.rlike(canon, F.lit(f"^{pattern}")), name(*parts)).otherwise(named)

        def letter(c: Column, i: Column) -> Column:
            out = c
            for pattern, alphabet in reversed(SCRIPTS):
                drawn = F.substr(F.lit(alphabet), value(i) % len(alphabet) + 1, F.lit(1))
                low = F.lower(c)
                drawn = F.when(low == c, drawn).otherwise(F.upper(drawn))
                out = F.when(F.rlike(low, F.lit(f"^{pattern}$")), drawn).otherwise(out)
            return F.when(F.rlike(c, F.lit(r"^\d$")), digit(i)).otherwise(out)

        shaped = F.array_join(F.transform(chars, letter), "")
        hexed = F.array_join(
            F.transform(
                chars,
                lambda c, i: F.when(F.rlike(c, F.lit("^[0-9a-f]$")), F.substring(F.lower(F.hex(value(i) % 16)), 1, 1))
                .when(F.rlike(c, F.lit("^[A-F]$")), F.hex(value(i) % 16))
                .otherwise(c),
            ),
            "",
        )
        numbers = F.array_join(F.transform(chars, lambda c, i: digit(i)), "")
        body = F.concat(F.lit("4"), F.substr(numbers, F.lit(2), F.length(canon) - 2))
        card = F.concat(body, ((10 - _luhn_sum(body, 0) % 10) % 10).cast("string"))
        account, country = F.substr(shaped, F.lit(5)), F.substr(canon, F.lit(1), F.lit(2))
        check = F.lpad((98 - _iban_check(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
        ip = F.concat_ws(".", *[(value(F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
        local = F.substring_index(shaped, "@", 1)
        email = F.concat(local, F.lit("@mail-"), F.substring(F.reverse(s), 1, 12), F.lit(".example.org"))
        return (
            F.when(kind == "email", email)
            .when(kind == "ip", ip)
            .when(kind == "card", card)
            .when(kind == "iban", F.concat(country, check, account))
            .when(kind.isin("phone", "ssn"), numbers)
            .when(kind.isin("family", "given_f", "given_m"), named)
            .when((kind == "secret") & F.rlike(canon, F.lit("^[0-9a-fA-F]+$")), hexed)
            .otherwise(shaped)
        )

    return let(stream, made)


def written(kind: Column, raw: Column, sur: Column) -> Column:
    """A surrogate in the separators, case and frame of the mention it replaces."""
    # A country code of a number that is longer than ten digits stays.
    code = F.when(kind == "phone", F.greatest(F.length(_digits(raw)) - NATIONAL, F.lit(0))).otherwise(F.lit(0))
    digits = F.concat(F.substr(_digits(raw), F.lit(1), code), sur)

    def filled(own: Column, slot: str) -> Column:
        """The characters of the mention with those of ``own`` in its slots, and what is longer after them."""
        put = F.aggregate(
            F.split(raw, ""),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda a, c: F.when(
                F.rlike(c, F.lit(slot)),
                F.struct(F.concat(a["out"], F.substr(own, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at")),
            ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        )
        return let(put, lambda p: F.concat(p["out"], F.substr(own, p["at"])))

    return (
        F.when(kind.isin(*DIGIT_TYPES), let(digits, lambda d: filled(d, r"^\d$")))
        .when(kind == "iban", filled(sur, "^[^ ]$"))
        .when(kind == "secret", F.concat(F.regexp_extract(raw, """^([^=:]*[=:]\\s*["'])""", 1), sur, F.right(raw, F.lit(1))))
        .when(kind == "name", F.concat(F.regexp_extract(raw, rf"^({_FRAME})", 1), sur))
        .when((kind == "email") & (F.upper(raw) == raw), F.upper(sur))
        .otherwise(sur)
    )


def _units_of(text: Column) -> Column:
    """Array of (kind, canon) of the units of a text's entities."""
    return F.flatten(F.transform(entities(text), lambda e: units(e["kind"], e["raw"], e["canon"])))


def attempts(docs: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt of the units whose first surrogate collides with another's or with an original.

    Only what collides is drawn again, and compared with all that is settled.
    """
    found = docs.filter(F.rlike("text", F.lit(HINT))).select(F.explode(F.array_distinct(_units_of(F.col("text")))).alias("e"))
    known = checkpointed(found.select("e.*").filter("kind IS NOT NULL").distinct())
    # All words of names share one space.
    space = F.when(F.col("kind").isin("family", "given_f", "given_m"), "name").otherwise(F.col("kind")).alias("space")
    originals = known.select(space, F.lower("canon").alias("s")).distinct()
    settled, open_ = None, known.withColumn("attempt", F.lit(0))
    while True:
        drawn = checkpointed(
            open_.withColumn("sur", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
            .select("kind", "canon", "attempt", space, F.lower("sur").alias("s"))
        )
        first = drawn.groupBy("space", "s").agg(F.min(F.struct("kind", "canon")).alias("first"))
        taken = originals if settled is None else originals.unionByName(settled.select("space", "s"))
        fine = drawn.join(taken, ["space", "s"], "left_anti").join(first, ["space", "s"]).filter(F.struct("kind", "canon") == F.col("first")).drop("first")
        bad = checkpointed(drawn.join(fine.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        settled = checkpointed(fine if settled is None else settled.unionByName(fine))
        if bad.isEmpty():
            return settled.filter("attempt > 0").select("kind", "canon", "attempt")
        open_ = bad.select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the replaced entities in ``__kinds`` (array of types)."""
    retried = attempts(docs, key)
    mine = docs.withColumn("__map", F.lit(None).cast("map<string,int>"))
    if not retried.isEmpty():
        # Texts that hold one of the few redrawn entities, by digest.
        uses = (
            docs.select(F.md5("text").alias("__id"), F.explode(_units_of(F.col("text"))).alias("e"))
            .select("__id", "e.kind", "e.canon")
            .distinct()
            .join(retried, ["kind", "canon"])
            .groupBy("__id")
            .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "canon"), "attempt"))).alias("__map"))
        )
        mine = docs.withColumn("__id", F.md5("text")).join(uses, "__id", "left").drop("__id")

    def replaced(text: Column) -> Column:
        gaps = F.split(text, ANY, -1)
        tries = lambda u: F.coalesce(F.try_element_at(F.col("__map"), F.concat_ws(":", u["kind"], u["canon"])), F.lit(0))

        def one(e: Column) -> Column:
            """A found string, its type, what replaces it and, of names, the (word, surrogate) pairs."""
            made = F.transform(units(e["kind"], e["raw"], e["canon"]), lambda u: F.struct(u["canon"].alias("word"), surrogate(key, u["kind"], u["canon"], tries(u)).alias("sur")))

            def told(pairs: Column) -> Column:
                whole = F.array_join(F.transform(pairs, lambda p: p["sur"]), " ")
                out = F.when(e["kind"].isNull(), e["raw"]).otherwise(let(whole, lambda s: written(e["kind"], e["raw"], s)))
                names = F.when(e["kind"] == "name", pairs).otherwise(F.array().cast("array<struct<word:string,sur:string>>"))
                return F.struct(e["kind"].alias("kind"), out.alias("out"), names.alias("names"))

            return let(made, told)

        def joined(found: Column) -> Column:
            # A name's words hold letters, hyphens and apostrophes only.
            word = lambda n: F.concat(F.lit(r"(?<![\p{L}'’-])"), n["word"], F.lit(r"(?![\p{L}-])"))
            renamed = lambda names: lambda g: F.aggregate(names, g, lambda t, n: F.regexp_replace(t, word(n), n["sur"]))
            known = F.array_distinct(F.flatten(F.transform(found, lambda f: f["names"])))
            rest = let(known, lambda names: F.when(F.size(names) == 0, gaps).otherwise(F.transform(gaps, renamed(names))))
            pieces = F.zip_with(rest, F.transform(found, lambda f: f["out"]), lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
            return F.struct(
                F.array_join(pieces, "").alias("text"),
                F.array_compact(F.transform(found, lambda f: f["kind"])).alias("kinds"),
            )

        return let(F.transform(entities(text), one), joined)

    none = F.struct(F.col("text").alias("text"), F.array().cast("array<string>").alias("kinds"))
    may = F.coalesce(F.rlike("text", F.lit(HINT)), F.lit(False))
    done = mine.withColumn("__new", F.when(may, replaced(F.col("text"))).otherwise(none))
    return done.select(
        *[(F.col("__new.text").alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns],
        F.col("__new.kinds").alias("__kinds"),
    )


#: The query's key; a deployment passes its own secret.
QUERY_KEY = "surrogates-of-the-public-query"


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    others = lambda t: F.size(F.array_remove("__kinds", t))
    counts = [(F.size("__kinds") - others(t)).cast("long").alias(f"n_{t}") for t in TYPES]
    return done.select("doc_id", "text", F.size("__kinds").cast("long").alias("n_entities"), *counts)
