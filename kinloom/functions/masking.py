"""Repeatable masking of nested profiles with column expressions.

A plan says, for each column, which kind of made-up value takes the place of each field; the
column's type says how to get there (structs, arrays of structs, maps).  Made-up values are picked
by the md5 of seed, row key, field path and position, so equal runs mask equally.  Null, '' and
empty lists or maps stay as they are; 0 and false are masked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Pools that made-up values are picked from.
DEGREES = ["B.Tech", "M.Tech", "MBA", "MD", "PhD", "B.Sc", "M.Sc"]
INDUSTRIES = ["Technology", "Healthcare", "Finance", "Manufacturing", "Retail"]
RELATIONS = ["Spouse", "Child", "Parent", "Sibling", "Cousin"]
MARITAL = ["Single", "Married", "Divorced"]

FIRST = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gina", "Hugo", "Ida", "Jan"]
LAST = ["Ashby", "Birch", "Cole", "Dunn", "Ellis", "Frost", "Gray", "Holt", "Ives", "Jarvis"]
WORDS = ["amber", "brook", "cedar", "delta", "ember", "field", "grove", "haven", "inlet", "jetty"]
FIRMS = ["Group", "Holdings", "Partners", "Works", "Trust"]
CITIES = ["Northport", "Eastvale", "Southam", "Westbury", "Midford"]
STATES = ["Upland", "Lowland", "Lakeside", "Ridge"]
COUNTRIES = ["Arcadia", "Borduria", "Freedonia", "Ruritania"]
JOBS = ["Analyst", "Engineer", "Teacher", "Broker", "Curator", "Surveyor"]


def number(key: Column, salt: str, low: int, high: int) -> Column:
    """A whole number in [low, high] from the key's hash."""
    digest = F.md5(F.concat_ws("|", key, F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (high - low + 1) + low


def pick(key: Column, salt: str, pool: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (number(key, salt, 0, len(pool) - 1) + 1).cast("int"))


def fake_value(kind: str, key: Column) -> Column:
    """A made-up string of a kind; 'range:a:b', 'millions:a:b', 'thousands:a:b' and 'hundred_thousands:a:b' take bounds."""
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    n = lambda salt, low, high: number(key, salt, low, high).cast("string")
    word = lambda salt: pick(key, salt, WORDS)
    name, *bounds = kind.split(":")
    low, high = map(int, bounds) if bounds else (0, 0)
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), number(key, "day", 0, 19_000).cast("int")), "yyyy-MM-dd")
    company = text(F.initcap(word("w")), " ", pick(key, "firm", FIRMS))
    made = {
        "name": lambda: text(pick(key, "first", FIRST), " ", pick(key, "last", LAST)), "word": lambda: word("w"), "company": lambda: company,
        "university": lambda: text(company, " University"), "city": lambda: pick(key, "city", CITIES), "state": lambda: pick(key, "state", STATES),
        "country": lambda: pick(key, "country", COUNTRIES), "postcode": lambda: F.lpad(n("zip", 0, 99_999), 5, "0"),
        "address": lambda: text(n("no", 1, 999), " ", F.initcap(word("w")), " Street, ", pick(key, "city", CITIES)), "job": lambda: pick(key, "job", JOBS),
        "date": lambda: date, "year": lambda: n("year", 1970, 2024), "sentence": lambda: text(F.initcap(word("a")), " ", word("b"), " ", word("c"), "."),
        "phone": lambda: text("555-", F.lpad(n("tel", 0, 9_999), 4, "0")), "degree": lambda: pick(key, "degree", DEGREES), "industry": lambda: pick(key, "industry", INDUSTRIES),
        "relation": lambda: pick(key, "relation", RELATIONS), "marital": lambda: pick(key, "marital", MARITAL), "range": lambda: n("n", low, high),
        "millions": lambda: text("$", n("n", low, high), "M"), "thousands": lambda: text("$", n("n", low, high), "K"), "hundred_thousands": lambda: text("$", n("n", low, high), "00K"),
        "id10": lambda: text(n("head", 1, 9), F.lpad(n("tail", 0, 999_999_999), 9, "0")), "id6": lambda: n("n", 0, 999_999),
        "unit": lambda: (number(key, "n", 0, 999_999) / 1e6).cast("string"), "flag": lambda: (number(key, "n", 0, 1) == 1).cast("string"),
    }
    return made[name]()


def replace_if(original: Column, new: Column, dtype: T.DataType) -> Column:
    """``new`` unless the original is null, '' or an empty list or map."""
    empty = original.isNull()
    if isinstance(dtype, T.StringType):
        empty = empty | (original == "")
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        empty = empty | (F.size(original) == 0)
    return F.when(empty, original).otherwise(new.cast(dtype))


@dataclass
class Fields:
    """What masks the fields of a struct, or of every struct in a list; fields not named stay."""

    kinds: dict = field(default_factory=dict)


@dataclass
class Values:
    """What masks every value of a map (and of the lists in it)."""

    plan: object


VS = lambda kind: Fields({"value": kind, "source": "word"})

#: The plan of a nested profile, as text: what kind of value masks each field.
PROFILE = {
    "fa_id": "id6", "added_on": "date", "fa_name": "name", "completeness_score": "unit", "is_favourite": "flag",
    "business_information": Fields({
        "name": VS("company"), "type": VS("word"), "address": Fields({"city": "city", "state": "state", "country": "country", "zip_code": "postcode", "source": "word"}), "business_address": "address",
        "industry": VS("industry"), "employees": VS("range:1:5000"), "business_role": VS("job"), "annual_revenue": VS("millions:1:50"), "years_in_business": VS("range:1:60"),
    }),
    "career": Fields({"career_history": Fields({"type": "job", "company": "company", "start_date": "date", "end_date": "date", "position_held": "job"}), "career_highlights": VS("sentence")}),
    "charitable_activity": Fields({
        "charitable_roles": Fields({"title": "job", "source": "word"}), "charitable_giving": Fields({"type": "word", "year": "year", "donation": "hundred_thousands:1:5", "organization": "company", "source": "word"}),
        "philanthropy_profile": VS("sentence"), "charitable_giving_checklist": Values("flag"),
    }),
    "connections": Fields({"name": "name", "group": "word", "relationship_type": "word", "source": "word"}),
    "education": Fields({"institution": "university", "qualification": "degree", "start_date": "date", "end_date": "date", "source": "word"}),
    "family_details": Fields({"members": Fields({"name": "name", "age": "range:0:100", "relationship": "relation", "source": "word"})}),
    "family_office": Fields({"source": "word", "value": Fields({"name": "name", "relationship": "relation", "age": "range:0:100", "source": "word"})}),
    "private_foundation": Fields({"source": "word", "value": Fields({"total_assets": "millions:1:50", "total_income": "millions:1:10", "year": "year", "phone": "phone", "address": "address", "source": "word"})}),
    "interests": Fields({"interests": VS("word"), "interests_remarks": VS("sentence")}),
    "personal_details": Fields({"age": VS("range:18:80"), "bio": VS("sentence"), "location": VS("address"), "marital_status": VS("marital")}),
    "net_worth": Values(VS("millions:1:20")),
    "real_estate": Fields({"taxes": "thousands:1:5", "address": "address", "property_type": "word", "mortgage_value": "thousands:50:300", "mortgage_lender": "company", "est_market_value": "thousands:200:1000", "source": "word"}),
}


def masked(column: Column, dtype: T.DataType, plan, key: Column, path: str) -> Column:
    """The column's masked form, by its type and plan; ``key`` identifies the row (and the places in lists above)."""
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x, i: masked(x, dtype.elementType, plan, F.concat_ws("|", key, i.cast("string")), path))
    if isinstance(plan, Values):
        return F.transform_values(column, lambda k, v: masked(v, dtype.valueType, plan.plan, F.concat_ws("|", key, k), path))
    if isinstance(plan, Fields):
        out = column
        for name, inner in plan.kinds.items():
            if name in dtype.names:
                out = out.withField(name, masked(column[name], dtype[name].dataType, inner, key, f"{path}.{name}"))
        return out
    return replace_if(column, fake_value(plan, F.concat_ws("|", key, F.lit(path))), dtype)


def mask_columns(df: DataFrame, plan: dict, id_column: str = "id", seed: int = 0) -> DataFrame:
    """``df`` with the plan's columns masked in one projection; columns that are not there are passed over."""
    key = F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string"))
    return df.select(*[masked(F.col(f.name), f.dataType, plan[f.name], key, f.name).alias(f.name) if f.name in plan else F.col(f.name) for f in df.schema])


def mask_name(name: Column, source: Column, key: Column) -> Column:
    """A struct (value, source) from a name and its source, both masked."""
    string = T.StringType()
    return F.struct(replace_if(name, fake_value("name", F.concat_ws("|", key, F.lit("name.value"))), string).alias("value"), replace_if(F.coalesce(source, F.lit("")), fake_value("word", F.concat_ws("|", key, F.lit("name.source"))), string).alias("source"))


def mask_profiles(df: DataFrame, seed: int = 0, strict: bool = False) -> DataFrame:
    """All columns of a profile masked; id becomes a made-up ten-digit number, name a struct.

    ``strict`` also masks the source of career entries, which is left alone otherwise.
    """
    key = F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))
    plan = dict(PROFILE)
    if strict:
        plan["career"] = Fields({**PROFILE["career"].kinds, "career_history": Fields({**PROFILE["career"].kinds["career_history"].kinds, "source": "word"})})
    source = F.col("name_source") if "name_source" in df.columns else F.lit(None).cast("string")
    out = []
    for f in df.schema:
        if f.name == "id":
            out.append(replace_if(F.col("id"), fake_value("id10", F.concat_ws("|", key, F.lit("id"))), f.dataType).alias("id"))
        elif f.name == "name":
            out.append(mask_name(F.col("name"), source, key).alias("name"))
        elif f.name in plan:
            out.append(masked(F.col(f.name), f.dataType, plan[f.name], key, f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
