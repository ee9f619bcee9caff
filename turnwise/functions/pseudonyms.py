"""Deterministic pseudonyms from a digest of (label, key), as column expressions.

The digest is SHA-256 of ``LABEL:key`` with the key trimmed, small and without accents.  Its remainders are folded over
eight 32-bit pieces: with bigint up to 10^9, with decimal(38) beyond.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


@dataclass(frozen=True)
class Pools:
    """Names to pick from; ours are invented."""

    first: list[str] = field(default_factory=lambda: "Avel Brune Cléa Dorian Elwen Faustin Galia Hector Isaure Joris Kelia Liam Maud Nils Oriane Paulin Quitterie Rémi Solène Titouan Ulysse Vania Wandrille".split())
    last: list[str] = field(default_factory=lambda: "Abrial Bossuge Carvel Delmas Esnault Fabron Gorlin Hamel Imbert Jaffre Kerbrat Lauzier Mazin Nodier Orsel Pradel Quinet Rochas Sablon Tavel".split())
    roots: list[str] = field(default_factory=lambda: "Alizé Boréal Cardinal Delta Écume Fanal Galion Hélice Indigo Jonquille Kappa Lagune Mistral Nacre Oméga Pergola Quartz".split())
    suffixes: list[str] = field(default_factory=lambda: "Conseil Services Groupe Atelier Réseau Solutions Études Ingénierie Collectif Maison".split())
    cities: list[str] = field(default_factory=lambda: "Aubrac Beaulieu Cormont Dunault Estival Fontarel Givray Hautmont Isigné Jarzac Kernoël Lussard Mirebel Neuvic Orbeil Puymorin Quincé Rivesel Saulnac Tressan".split())


def folded_key(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(F.trim(key)), ACCENTS, PLAIN), "œ", "oe"), "æ", "ae")


def digest(label: Column, key: Column) -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat(F.upper(label), F.lit(":"), folded_key(key)), 256)


def pieces(hexadecimal: Column) -> Column:
    """The digest's eight 32-bit numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substring(hexadecimal, k * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))


def remainder(numbers: Column, n: int) -> Column:
    """The digest, given as its pieces, modulo ``n``."""
    kind = "decimal(38,0)" if n > 10**9 else "bigint"
    one = F.lit(str(1 << 32)).cast("decimal(10,0)" if n > 10**9 else "bigint")
    of = F.lit(str(n)).cast(kind)
    return F.aggregate(numbers, F.lit(0).cast(kind), lambda acc, x: (((acc * one + x.cast(kind)).cast(kind)) % of).cast(kind))


def quotient_remainder(numbers: Column, a: int, b: int) -> Column:
    """The digest divided by ``a``, modulo ``b``."""
    return F.floor(remainder(numbers, a * b) / F.lit(a)).cast("long")


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def _digits(value: Column, n: int) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def _grouped(digits: Column, size: int) -> Column:
    return F.trim(F.regexp_replace(digits, "(.{%d})" % size, "$1 "))


def candidate(label: Column, key: Column, pools: Pools = Pools()) -> Column:
    """The pseudonym of a key before collisions are resolved."""
    name = F.upper(label)
    return F.element_at(F.transform(F.array(pieces(digest(label, key))), lambda h: _candidate(name, key, h, pools)), 1)


def _candidate(name: Column, key: Column, h: Column, pools: Pools) -> Column:
    r = lambda n: remainder(h, n)
    q = lambda a, b: quotient_remainder(h, a, b)
    phone = F.concat(F.lit("+33 "), _grouped(F.concat(F.when(r(2) == 0, "06").otherwise("07"), _digits(r(10**8), 8)), 2))
    handle = F.regexp_replace(folded_key(key), "[^a-z0-9]+", "")
    mail = F.concat(F.substring(F.when(handle == "", "contact").otherwise(handle), 1, 14), F.lit("."), _digits(r(1000), 3), F.lit("@exemple.fr"))
    iban = F.concat(F.lit("FR"), _digits(r(97), 2), F.lit(" "), _grouped(_digits(r(10**23), 23), 4))
    date = F.concat(_digits(q(13, 28) + 1, 2), F.lit("/"), _digits(q(7, 12) + 1, 2), F.lit("/"), (F.lit(2018) + r(8)).cast("string"))
    return (
        F.when(name == "PERSON", F.concat(_pick(pools.first, r(len(pools.first))), F.lit(" "), _pick(pools.last, q(13, len(pools.last)))))
        .when(name == "ORGANIZATION", F.concat(_pick(pools.roots, r(len(pools.roots))), F.lit(" "), _pick(pools.suffixes, q(7, len(pools.suffixes)))))
        .when(name == "LOCATION", _pick(pools.cities, r(len(pools.cities))))
        .when(name == "PHONE", phone).when(name == "EMAIL", mail).when(name.isin("IBAN", "ACCOUNT"), iban)
        .when(name == "SIRET", _digits(r(10**14), 14)).when(name.isin("SIREN", "SIREN_SIRET"), _digits(r(10**9), 9))
        .when(name == "DATE", date).when(name == "URL", F.concat(F.lit("https://exemple.fr/res-"), _digits(r(10**6), 6)))
        .otherwise(F.concat(F.lit("ANON-"), name, F.lit("-"), _digits(r(10**4), 4)))
    )


def pseudonyms(keys: DataFrame, pools: Pools = Pools()) -> DataFrame:
    """scope, label, key, pseudonym: keys equal after folding share one, and no two keys of a scope have the same.

    ``keys`` has scope, label, key, first_pos.  The k-th key with a candidate gets ``candidate k`` (from 2 to 50), those after
    it ``candidate ddd`` of their digest, and the r-th of equal ones ``candidate ddd-r``.  Only the first 50 of a candidate
    are ranked together, which are picked before the shuffle; the others are ranked by candidate and digits.
    """
    folded = keys.select("scope", F.upper("label").alias("label"), folded_key(F.col("key")).alias("folded"), "key", "first_pos")
    own = folded.groupBy("scope", "label", "folded").agg(F.min("first_pos").alias("_first"))
    own = own.withColumn("_candidate", candidate(F.col("label"), F.col("folded"), pools))
    order = [F.col("_first"), F.col("label"), F.col("folded")]
    k = F.row_number().over(Window.partitionBy("scope", "_candidate").orderBy(*order))
    first = own.withColumn("_k", k).where(F.col("_k") <= 50)
    place = ["scope", "label", "folded"]
    tail = _digits(remainder(pieces(digest(F.col("label"), F.col("folded"))), 1000), 3)
    rest = own.join(first.select(*place), place, "left_anti").withColumn("_tail", tail)
    r = F.row_number().over(Window.partitionBy("scope", "_candidate", "_tail").orderBy(*order))
    named = first.select(*place, F.when(F.col("_k") == 1, F.col("_candidate")).otherwise(F.concat("_candidate", F.lit(" "), "_k")).alias("pseudonym"))
    again = rest.withColumn("_r", r).select(*place, F.concat("_candidate", F.lit(" "), "_tail", F.when(F.col("_r") > 1, F.concat(F.lit("-"), "_r")).otherwise("")).alias("pseudonym"))
    return folded.select(*place, "key").distinct().join(named.unionByName(again), place).select("scope", "label", "key", "pseudonym")
