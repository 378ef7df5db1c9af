"""Invented customer records for demonstrations, the same for the same number.

The generator's state is a counter, so a record's n-th random number follows from its number alone: any row can be made
without those before it, in any task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import let
from .tables import spread

# The generator's seed and step, and the words that records are made of.
SEED, STEP = 20260101, 0x6D2B79F5
MEN = "Amit Ravi Suresh Vijay Rakesh Sanjay Deepak Manoj Ajay Arun Naveen Pankaj Rajesh Vikram Yogesh".split()
WOMEN = "Sunita Pooja Anita Kavita Rekha Meena Neha Priya Geeta Shalini Vandana Kiran Nisha Sarita Usha".split()
SURNAMES = "Kumar Singh Sharma Verma Yadav Gupta Prasad Mishra Chauhan Rathi Pandey Jha Thakur Patel".split()
VILLAGES = "Rampur Sultanpur Madhopur Bishunpur Chandpur Devpur Kishanganj Narsinghpur".split()
DISTRICTS = [("Muzaffarpur", "Bihar"), ("Gorakhpur", "Uttar Pradesh"), ("Dhanbad", "Jharkhand"), ("Bhilwara", "Rajasthan"), ("Ratlam", "Madhya Pradesh")]
CATEGORIES = "general obc sc st ews".split()
BANKS = ["State Bank of India", "Punjab National Bank", "Bank of Baroda", "Canara Bank"]
#: Random numbers that a record takes.
DRAWS = 42

_LOW = 0xFFFFFFFF


def _word(c: Column) -> Column:
    """The low 32 bits."""
    return c.bitwiseAND(F.lit(_LOW))


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of the product of two words, by halves: nothing reaches 64 bits."""
    high = (a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)) * 65536
    return _word(high + a * b.bitwiseAND(F.lit(0xFFFF)))


def draw(seed: Column, n: Column) -> Column:
    """The n-th number (from 1) of the generator with this seed, from 0 up to 1."""
    step = _word(n.cast("long") * STEP)
    first = let(_word(seed.cast("long") + step), lambda a: _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1))))
    second = let(first, lambda t: _word(t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseXOR(t))
    return let(second, lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(float(1 << 32)))


def records(numbers: DataFrame) -> DataFrame:
    """numbers: (number). The invented record of each number; the twelve-digit identifier's last digits are always zeros, and mobile numbers, codes and accounts are of ranges that nobody has."""
    rows = spread(numbers, "number").withColumn("_r", F.transform(F.sequence(F.lit(1), F.lit(DRAWS)), lambda n: draw(F.col("number") + SEED, n)))
    below = lambda n, most: F.floor(F.get("_r", F.lit(n)) * most).cast("int")
    pick = lambda n, items: F.element_at(F.array(*map(F.lit, items)), below(n, len(items)) + 1)
    digits = lambda n, count: F.concat(*[below(i, 10).cast("string") for i in range(n, n + count)])
    male = F.col("number") % 2 == 0
    surname = pick(1, SURNAMES)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    own = {
        "full_name": F.concat_ws(" ", F.when(male, pick(0, MEN)).otherwise(pick(0, WOMEN)), surname),
        "gender": F.when(male, "male").otherwise("female"),
        "father_name": F.concat_ws(" ", pick(2, MEN), surname),
        "mother_name": F.concat_ws(" ", pick(3, WOMEN), surname),
        "district": pick(4, [d for d, _ in DISTRICTS]),
        "state": pick(4, [s for _, s in DISTRICTS]),
        "date_of_birth": F.concat_ws("-", (below(5, 35) + 1970).cast("string"), two(below(6, 12) + 1), two(below(7, 28) + 1)),
        "mobile": F.concat(F.lit("99000"), digits(8, 5)),
        "category": pick(13, CATEGORIES),
        "village": pick(14, VILLAGES),
        "pincode": F.concat(F.lit("9"), digits(15, 5)),
        "aadhaar_last4": F.lit("0000"),
        "pan": F.concat(F.lit("ZZZP"), F.chr(F.col("number") % 26 + 65), digits(20, 4), F.lit("Q")),
        "account_number": F.concat(F.lit("000"), digits(24, 11)),
        "ifsc": F.concat(F.lit("ZZZB0"), digits(35, 6)),
        "bank_name": pick(41, BANKS),
    }
    return rows.select("number", *[c.alias(n) for n, c in own.items()])
