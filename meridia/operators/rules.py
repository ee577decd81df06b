"""Rules by which registry entries of like names belong together: predicates on pairs, and groups in which every two agree.

An entry's facts are normalised once, into one struct; a rule is a condition on
two such structs. Groups are checked on the distinct facts of a block, first
against one of them and only then pair by pair, so that copies cost nothing and
a block that fails does so in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.text import SHARED_EXACT, address_form, contact_domain, host_registry, locality_form, name_text
from meridia.operators.grouping import BED_TOLERANCE, SHADOW_SHARE, SHADOW_SIBLINGS, overlaps, similar_address
from meridia.operators.pairing import blocked_join, tagged
from meridia.session import cut

#: Numbers beyond this are no numbering of houses.
MOST_SUFFIX = 100
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
Rule = Callable[[Column, Column], Column]


def entry_facts(entries: DataFrame) -> DataFrame:
    """(id, x) of each ready entry: its facts as the rules compare them; repeated entries count once."""
    none = F.array().cast("array<string>")
    held = lambda f, x: F.when(F.col(f).isNotNull(), x)
    list_ = lambda f: F.array_sort(F.array_distinct(F.coalesce(F.col(f"contacts.{f}"), none)))
    own = lambda f, of: F.array_sort(F.array_distinct(F.filter(F.transform(list_(f), of), lambda d: (d != "") & ~d.isin(*SHARED_EXACT))))
    c = F.col
    x = F.struct(
        c("name.normalized").alias("name"), c("name.basename").alias("base"), c("name.suffix").alias("suffix"), c("establishmenttype").alias("kind"), F.size(F.coalesce("issues", none)).alias("issues"),
        held("location.district", name_text(c("location.district"))).alias("district"), held("location.locality", name_text(c("location.locality"))).alias("locality"),
        held("location.locality", locality_form(c("location.locality"))).alias("place"), held("location.postcode", name_text(c("location.postcode"))).alias("postcode"),
        held("location.address", address_form(c("location.address"))).alias("address"), held("operator", name_text(c("operator"))).alias("operator"), c("capacity.rooms").alias("rooms"), c("capacity.beds").alias("beds"),
        list_("phones").alias("phones"), list_("emails").alias("emails"), own("domains", contact_domain).alias("domains"), own("websites", host_registry).alias("hosts"),
    )
    return entries.where("status = 'ready'").dropDuplicates(["_id"]).select(F.col("_id").alias("id"), x.alias("x"))


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def same(a: Column, b: Column) -> Column:
    return _no(a == b)


def conflicting(a: Column, b: Column) -> Column:
    return _no(a != b)


def like_place(a: Column, b: Column) -> Column:
    """Equal, or one within the other; an empty form is within any."""
    return _no(a.contains(b) | b.contains(a))


def like_address(a: Column, b: Column) -> Column:
    return _no((a != "") & (b != "") & (a.contains(b) | b.contains(a) | similar_address(a, b)))


def share_contact(l: Column, r: Column) -> Column:  # noqa: E741
    """A telephone, an e-mail address, or a domain or host of their own in common."""
    return overlaps(l.phones, r.phones) | overlaps(l.emails, r.emails) | overlaps(l.domains, r.domains) | overlaps(l.hosts, r.hosts)


def like_operator(l: Column, r: Column) -> Column:  # noqa: E741
    return l.operator.isNull() | r.operator.isNull() | same(l.operator, r.operator) | overlaps(l.phones, r.phones) | overlaps(l.emails, r.emails)


def strict_location(l: Column, r: Column) -> Column:  # noqa: E741
    """No conflict of postcode or locality; addresses alike where both are known, else postcode and locality equal."""
    apart = conflicting(l.postcode, r.postcode) | (l.place.isNotNull() & r.place.isNotNull() & ~like_place(l.place, r.place))
    both = l.address.isNotNull() & r.address.isNotNull()
    return ~apart & F.when(both, like_address(l.address, r.address)).otherwise(same(l.postcode, r.postcode) & same(l.locality, r.locality))


def strong_location(l: Column, r: Column) -> Column:  # noqa: E741
    """No conflict of postcode or district; addresses alike where both are known, else a locality that stands for both, if need be the one the district's name holds."""
    both = l.address.isNotNull() & r.address.isNotNull()
    district = F.coalesce(l.district, r.district, F.lit(""))
    holds = lambda t: _no((t != "") & district.contains(t))
    one = F.when(l.place.isNull() | r.place.isNull(), l.place.isNotNull() | r.place.isNotNull()).otherwise(like_place(l.place, r.place) | (holds(l.locality) != holds(r.locality)))
    return ~conflicting(l.postcode, r.postcode) & ~conflicting(l.district, r.district) & F.when(both, like_address(l.address, r.address)).otherwise(one)


def numbered_location(l: Column, r: Column) -> Column:  # noqa: E741
    both = l.address.isNotNull() & r.address.isNotNull()
    return like_place(l.place, r.place) | (both & like_address(l.address, r.address))


def is_number(suffix: Column) -> Column:
    return _no(suffix.rlike(r"^\d+[A-Z]?$"))


def plausible(suffix: Column) -> Column:
    return is_number(suffix) & _no(F.regexp_extract(suffix, r"^(\d+)", 1).try_cast("long") <= MOST_SUFFIX)


def numbered_pair(l: Column, r: Column) -> Column:  # noqa: E741
    """Two numbered houses of one name: without issues, of one postcode, at a like place, with a contact in common and no other operator."""
    clean = (l.issues == 0) & (r.issues == 0) & is_number(l.suffix) & is_number(r.suffix)
    return clean & same(l.base, r.base) & same(l.postcode, r.postcode) & numbered_location(l, r) & share_contact(l, r) & like_operator(l, r)


def artifact_pair(l: Column, r: Column) -> Column:  # noqa: E741
    """A name and its numbered likes: a missing or plausible number, one postcode, a like place or, where an address is missing, one district; operators equal unless both are numbered."""
    fits = lambda s: s.isNull() | plausible(s)
    clean = (l.issues == 0) & (r.issues == 0) & fits(l.suffix) & fits(r.suffix)
    missing = l.address.isNull() | r.address.isNull()
    place = numbered_location(l, r) | (missing & same(l.district, r.district))
    strict = l.operator.isNull() | r.operator.isNull() | same(l.operator, r.operator)
    operator = F.when(l.suffix.isNotNull() & r.suffix.isNotNull(), like_operator(l, r)).otherwise(strict)
    return clean & same(l.base, r.base) & same(l.postcode, r.postcode) & place & share_contact(l, r) & operator


def agreeing_blocks(members: DataFrame, block: str, rule: Rule) -> DataFrame:
    """(block, members): the blocks of two or more members of which every two agree by the rule.

    members: block, id, x. Members of equal facts are one class. Each class is held
    against the least one of its block; blocks that pass are checked pair by
    pair, split where they are large. A null answer is no agreement.
    """
    classes = cut(members.where(F.col(block).isNotNull()).groupBy(block, "x").agg(F.count("*").alias("n")).withColumn("k", F.xxhash64("x")))
    seeds = classes.groupBy(block).agg(F.min_by("x", "k").alias("s"), F.min("k").alias("sk"), F.sum("n").alias("members"), F.count("*").alias("classes")).where("members > 1")
    held = classes.join(seeds, block)
    fails = (F.col("n") > 1) & ~_no(rule(F.col("x"), F.col("x"))) | (F.col("k") != F.col("sk")) & ~_no(rule(F.col("x"), F.col("s")))
    passed = cut(held.groupBy(block).agg(F.max("members").alias("members"), F.max("classes").alias("classes"), F.bool_or(fails).alias("f")).where("not f").drop("f"))
    several = classes.join(seeds.select(block, "sk"), block).where(F.col("k") != F.col("sk")).join(passed.where("classes > 2").select(block), block, "left_semi")
    l, r = several.select(block, F.col("x").alias("l"), F.col("k").alias("lk")), several.select(block, F.col("x").alias("r"), F.col("k").alias("rk"))  # noqa: E741
    apart = blocked_join(l, r, [block]).where((F.col("lk") < F.col("rk")) & ~_no(rule(F.col("l"), F.col("r")))).select(block).distinct()
    return passed.join(apart, block, "left_anti").select(block, "members")


def same_name_groups(facts: DataFrame) -> DataFrame:
    """(name, members, multi_type, strong_identity, collapse): for each name of two or more entries which rules hold for all of them.

    multi_type: of several kinds, sharing contacts, location and operator;
    strong_identity: of one kind, of exactly the same capacity, at one place by
    strong_location; collapse: of one kind, as multi_type, and of a capacity like
    the first entry's by id.
    """
    m = facts.select(F.col("x.name").alias("name"), "id", "x")
    size = m.groupBy("name").agg(F.count("*").alias("members"), F.count_distinct(F.coalesce("x.kind", F.lit("\u0000"))).alias("kinds"), F.count_distinct(F.struct("x.rooms", "x.beds")).alias("sizes"), F.min_by(F.struct("x.rooms", "x.beds"), "id").alias("first")).where("members > 1")
    near = F.coalesce(F.col("x.rooms") == F.col("first.rooms"), F.lit(True)) & F.coalesce(F.abs(F.col("x.beds") - F.col("first.beds")) <= BED_TOLERANCE, F.lit(True))
    fit = m.join(size, "name").groupBy("name").agg(F.bool_and(near).alias("fit"))
    usual = agreeing_blocks(m, "name", lambda l, r: share_contact(l, r) & strict_location(l, r) & like_operator(l, r)).select("name", F.lit(True).alias("_usual"))
    strong = agreeing_blocks(m, "name", lambda l, r: share_contact(l, r) & strong_location(l, r) & like_operator(l, r)).select("name", F.lit(True).alias("_strong"))
    j = size.join(fit, "name").join(usual, "name", "left").join(strong, "name", "left")
    return j.select("name", "members", (_no(F.col("_usual")) & (F.col("kinds") > 1)).alias("multi_type"), (_no(F.col("_strong")) & (F.col("kinds") == 1) & (F.col("sizes") == 1)).alias("strong_identity"), (_no(F.col("_usual")) & (F.col("kinds") == 1) & F.col("fit")).alias("collapse"))


def complex_groups(facts: DataFrame, bases: list[str], least: int = 2) -> DataFrame:
    """(base, members): of each given base the entries named base and one letter, at least so many, none with issues, that all share contacts and location."""
    names = facts.sparkSession.createDataFrame([(f"{b} {c}", b) for b in bases for c in LETTERS], "name string, base string")
    m = facts.join(F.broadcast(names), F.col("x.name") == F.col("name")).select("base", "id", "x")
    clean = m.groupBy("base").agg(F.max("x.issues").alias("i")).where("i = 0").select("base")
    return agreeing_blocks(m.join(clean, "base", "left_semi"), "base", lambda l, r: share_contact(l, r) & strict_location(l, r)).where(F.col("members") >= least)


def neighbours(facts: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): ids of entries that agree by the rule, both ways and each with itself where it agrees with itself; met by base, postcode and a contact in common, which the rules ask for."""
    tokens = F.array_distinct(F.concat(tagged("p:", F.col("x.phones")), tagged("e:", F.col("x.emails")), tagged("d:", F.col("x.domains")), tagged("h:", F.col("x.hosts"))))
    each = facts.where(F.col("x.base").isNotNull() & (F.trim("x.base") != "") & F.col("x.postcode").isNotNull()).select("id", F.col("x.base").alias("base"), F.col("x.postcode").alias("code"), F.explode(tokens).alias("token"))
    met = cut(blocked_join(each.withColumnRenamed("id", "a"), each.withColumnRenamed("id", "b"), ["base", "code", "token"]).where("a <= b").select("a", "b").distinct())
    side = lambda k, x: facts.select(F.col("id").alias(k), F.col("x").alias(x))
    found = cut(met.join(side("a", "l"), "a").join(side("b", "r"), "b").where(_no(rule(F.col("l"), F.col("r")))).select("a", "b"))
    return found.unionByName(found.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))


def seed_groups(facts: DataFrame, rule: Rule, extra: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, members, first): the entries whose neighbours, two or more, all agree with each other, with how many these are and the least of them.

    Each entry is a seed of its own. That a neighbour has fewer neighbours than
    its seed rules the group out before any two of them are compared. extra keeps
    those of the groups (id, member) that fulfil another condition.
    """
    near = cut(neighbours(facts, rule))
    degree = near.groupBy("a").agg(F.count("*").alias("n"))
    possible = near.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("n").alias("m")), "b").groupBy("a").agg(F.max("n").alias("n"), F.min("m").alias("least"), F.min("b").alias("first")).where("n > 1 and least >= n")
    of = cut(near.join(possible.select("a"), "a", "left_semi").select(F.col("a").alias("seed"), F.col("b").alias("member")))
    if extra is not None:
        of = cut(extra(of))
    l, r = of.withColumnRenamed("member", "a"), of.withColumnRenamed("member", "b")  # noqa: E741
    agree = blocked_join(l, r, ["seed"]).where("a < b").join(near.where("a < b"), ["a", "b"], "left_semi").groupBy("seed").agg(F.count("*").alias("pairs"))
    sizes = of.groupBy("seed").agg(F.count("*").alias("members"), F.min("member").alias("first"))
    return sizes.join(agree, "seed").where("members > 1 and pairs = members * (members - 1) / 2").select(F.col("seed").alias("id"), "members", "first")


def numbered_groups(facts: DataFrame) -> DataFrame:
    """(id, members, first): seeds of numbered houses that belong together."""
    return seed_groups(facts, numbered_pair)


def artifact_groups(facts: DataFrame) -> DataFrame:
    """(id, members, first): seeds of a name with its numbered likes; of each group one member has a number and one none."""
    suffix = facts.select(F.col("id").alias("member"), F.col("x.suffix").alias("suffix"))

    def mixed(of: DataFrame) -> DataFrame:
        both = of.join(suffix, "member").groupBy("seed").agg(F.bool_or(F.col("suffix").isNull()).alias("base"), F.bool_or(plausible(F.col("suffix"))).alias("number")).where("base and number").select("seed")
        return of.join(both, "seed", "left_semi")

    return seed_groups(facts, artifact_pair, mixed)


def shadow_entries(facts: DataFrame) -> DataFrame:
    """(id, siblings): entries without a number that only sum up others: at least SHADOW_SIBLINGS purely numbered ones of the base, kind and postcode share a telephone or an own domain and a like address with it, all with known capacity, each smaller, and their sums within SHADOW_SHARE."""
    part = lambda k, where: facts.where(where & F.col("x.postcode").isNotNull() & F.col("x.kind").isNotNull() & (F.trim("x.base") != "")).select(F.col("id").alias(k), F.col("x").alias(f"_{k}"), F.col("x.base").alias("base"), F.col("x.kind").alias("kind"), F.col("x.postcode").alias("code"))
    whole = part("id", F.col("x.suffix").isNull() & F.col("x.rooms").isNotNull() & F.col("x.beds").isNotNull())
    one = part("part", _no(F.col("x.suffix").rlike(r"^\d+$")))
    a, b = F.col("_id"), F.col("_part")
    met = blocked_join(whole, one, ["base", "kind", "code"]).where((overlaps(a.phones, b.phones) | overlaps(a.domains, b.domains)) & like_address(a.address, b.address))
    sums = met.groupBy("id", F.col("_id.rooms").alias("rooms"), F.col("_id.beds").alias("beds")).agg(F.count("*").alias("siblings"), *[f(F.col(f"_part.{c}")).alias(f"{n}_{c}") for c in ("rooms", "beds") for n, f in (("n", F.count), ("sum", F.sum), ("max", F.max))])
    ok = F.col("siblings") >= SHADOW_SIBLINGS
    for c in ("rooms", "beds"):
        ok = ok & (F.col(f"n_{c}") == F.col("siblings")) & (F.col(c) > F.col(f"max_{c}")) & (F.col(f"sum_{c}") != 0) & (F.abs(F.col(f"sum_{c}") - F.col(c)) / F.col(f"sum_{c}") <= SHADOW_SHARE)
    return sums.where(_no(ok)).select("id", "siblings")
