"""Template tickets derived from keyed tables: one ticket per order, no randomness, no driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: categories with the upper bound of their share on a 0..19 key scale, channels and priorities ---------
CATEGORY_SHARES = (("billing", 4), ("shipping", 8), ("product_quality", 12), ("technical_support", 17), ("returns", 20))
CHANNELS = (("email", 6), ("chat", 11), ("phone", 14), ("web_form", 18), ("social_media", 20))
PRIORITIES = (("low", 3), ("medium", 11), ("high", 17), ("urgent", 20))

# Eight letters of a fictional club shop for each category.
TEXTS = {
    "billing": (
        "Our treasurer needs a stamped receipt for {order} from {date}, the amount is ${amount}.",
        "The raffle voucher over ${amount} was thrown away by {person}. Horrible, horrible behaviour, I am furious!!!",
        "{person} found a nice discount of {amount} USD for our choir, thank you so much!",
        "Could {org} split ${amount} into {days} small payments for the orchestra?",
        "Two of my bonus points are missing on {date}, is that an error?",
        "The membership is not cheap at ${amount}, but the garden evenings are really wonderful.",
        "A donation of {amount} dollars went to the harbour street depot and nobody wrote a note, this is disgraceful and I am angry!",
        "Which currency did {place} use for the tombola on {date}?",
    ),
    "shipping": (
        "The pallet for {place} waits behind the blue gate, the code is 4711.",
        "{person} carried the {product} up four floors and smiled, an outstanding courier!",
        "The crate with the {product} was opened by a fox. Absolutely disgusting, the straw is dirty!!",
        "May the van of {org} ring at the bakery after {date}?",
        "For {days} days the ferry to {place} did not sail, what a terrible and hopeless timetable, I hate it.",
        "Please write {order} on the lid in green ink.",
        "The bicycle messenger was never rude and quite fast, we are pleased.",
        "A goat ate the label of {order}, so the harbour street depot lost it.",
    ),
    "product_quality": (
        "Paint flakes off the {product} like snow, a really poor and worthless toy.",
        "My grandmother loves the {product}, it is excellent for her balcony!",
        "The {product} by {org} hums at night and the Safety officer of our school wants to see it.",
        "Only the left half of the {product} is dyed, the seam is broken.",
        "The {product} feels good in the hand but its bell is awful.",
        "We gave ${amount} for the {product}: a GREAT birthday present, I recommend it.",
        "This {product} is USELESS trash, {org} should be ashamed, here is my formal complaint!",
        "Does the {product} float, and may it swim in {place}?",
    ),
    "technical_support": (
        "On {moment} the {screen} shows last year's concert.",
        "With {device} the {screen} flickers {moment}, this is slightly annoying.",
        "Our club gave up: the {screen} turns pink on {device}. So frustrated!",
        "{person} drew a clear sketch of the {screen} for us, that was prompt and useful.",
        "Is there a larger font for the {screen} on {device}?",
        "For {days} days the {screen} speaks Latin. Horrible, horrible machine and a stupid parrot!!!",
        "The {screen} with captions is a wonderful idea, smooth and easy {moment}.",
        "The choir of {place} sings to the {screen} {moment}, may it record until {date}?",
    ),
    "returns": (
        "Where do we drop the {product} of {order}, at the harbour street depot?",
        "After {days} days in the cellar nobody took the {product} back. The clerk was extremely rude and unfair.",
        "{org} swapped our {product} for a drum, an exchange until {date} would do.",
        "On day {days} the refund of ${amount} for {order} lay in the letter box, I am very happy.",
        "{place} kept the {product} and gave {amount} USD to a circus. Our Legal adviser prepares a lawsuit!",
        "The form for sending things home is confusing, but {person} was patient and friendly.",
        "My twin returned the {product} as a joke. Angry, disappointed, the worst prank I know!",
        "Will the museum shop accept an unopened gift?",
    ),
}
CATEGORIES = tuple((name, bound, TEXTS[name]) for name, bound in CATEGORY_SHARES)
SCREENS = ("timeline", "seat map", "wish list", "photo wall", "recipe box", "guest book", "playlist")
DEVICES = ("a tablet", "an old phone", "the kitchen radio", "a smart watch", "a borrowed laptop")
MOMENTS = ("before breakfast", "during the match", "after midnight", "on the train")


def _by_bound(key: Column, choices: tuple[tuple[str, int], ...]) -> Column:
    out = None
    for value, bound in choices[:-1]:
        out = (F.when if out is None else out.when)(key < bound, F.lit(value))
    return out.otherwise(F.lit(choices[-1][0]))


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _div(key: Column, n: int) -> Column:
    """Whole-number division, exact for keys of any size."""
    return F.call_function("div", key, F.lit(n))


def pad_key(key: Column, width: int = 8) -> Column:
    """Zero-padded key; keys longer than the width are kept whole."""
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def ticket_source(
    orders: DataFrame, customer: DataFrame, supplier: DataFrame, part: DataFrame, nation: DataFrame
) -> DataFrame:
    """One support ticket per order, in the ticket schema."""
    people = customer.select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("person"), F.col("c_nationkey").alias("n_nationkey")
    )
    products = part.select(F.col("p_partkey").alias("o_custkey"), F.col("p_name").alias("product"))
    makers = supplier.select(F.col("s_suppkey").alias("org_key"), F.col("s_name").alias("org"))
    places = nation.select("n_nationkey", F.col("n_name").alias("place"))

    key = F.col("o_orderkey")
    per_twenty = key % 20
    turn = _div(key, 20)
    base = orders.select(
        "o_orderkey", "o_custkey", "o_orderdate",
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        _div(F.col("o_custkey"), 16).alias("org_key"),
    )
    # The customer and part joins share their key, so large tables are shuffled on it only once.
    joined = (
        base.join(people, "o_custkey", "left")
        .join(products, "o_custkey", "left")
        .join(places, "n_nationkey", "left")
        .join(makers, "org_key", "left")
    )

    category_index = F.lit(len(CATEGORIES) - 1)
    for i in reversed(range(len(CATEGORIES) - 1)):
        category_index = F.when(per_twenty < CATEGORIES[i][1], F.lit(i)).otherwise(category_index)
    templates = tuple(t for _, _, texts in CATEGORIES for t in texts)
    cents = F.col("cents") % 49001 + 999
    slots = {
        "order": F.concat(F.lit("ORD-"), pad_key(key, 6)),
        "amount": F.concat(_div(cents, 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")),
        "date": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "days": (key % 29 + 2).cast("string"),
        "person": F.coalesce("person", F.lit("your agent")),
        "product": F.coalesce("product", F.lit("item")),
        "org": F.coalesce("org", F.lit("your shop")),
        "place": F.coalesce("place", F.lit("my city")),
        "screen": _pick(SCREENS, turn % len(SCREENS)),
        "device": _pick(DEVICES, turn % len(DEVICES)),
        "moment": _pick(MOMENTS, _div(turn, 3) % len(MOMENTS)),
    }
    text = _pick(templates, F.col("category_index") * 8 + turn % 8)
    for name, value in slots.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return joined.withColumn("category_index", category_index).select(
        F.concat(F.lit("TKT-"), pad_key(key)).alias("ticket_id"),
        text.alias("text"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(key % 24).cast("int"))).alias("created_at"),
        _by_bound(_div(key, 11) % 20, PRIORITIES).alias("priority"),
        _by_bound(_div(key, 7) % 20, CHANNELS).alias("channel"),
        _pick(tuple(c for c, _, _ in CATEGORIES), F.col("category_index")).alias("category"),
    )
