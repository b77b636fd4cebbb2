"""Product families and forms as column expressions over canonical words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed words of the base families.
BASE_FAMILIES = {
    "milk": ["milk", "حليب"],
    "laban": ["laban", "لبن"],
    "yogurt": ["yogurt", "yoghurt", "زبادي", "روب"],
    "cheese": ["cheese", "جبن", "جبنه", "موزاريلا", "mozzarella", "شيدر", "cheddar", "حلوم", "halloumi", "فيتا", "feta", "قشقوان"],
    "cream": ["cream", "قشطه", "قشده", "كريمه"],
    "butter": ["butter", "زبده"],
    "eggs": ["egg", "eggs", "بيض"],
    "chicken": ["chicken", "دجاج", "فراخ"],
    "meat": ["meat", "beef", "لحم", "لحوم", "بقري", "غنم", "mutton"],
    "fish": ["fish", "tuna", "سمك", "تونه", "سلمون", "salmon", "سردين", "sardine", "sardines"],
    "rice": ["rice", "رز", "ارز"],
    "pasta": ["pasta", "spaghetti", "مكرونه", "معكرونه", "سباغيتي", "نودلز", "noodles", "شعيريه"],
    "bread": ["bread", "toast", "خبز", "توست", "صامولي"],
    "oil": ["oil", "زيت", "زيوت"],
    "water": ["water", "ماء", "مياه", "مويه"],
    "juice": ["juice", "عصير"],
    "tea": ["tea", "شاي"],
    "coffee": ["coffee", "قهوه", "نسكافيه", "nescafe"],
    "sugar": ["sugar", "سكر"],
    "flour": ["flour", "دقيق", "طحين"],
    "dates": ["dates", "تمر", "تمور"],
    "honey": ["honey", "عسل"],
    "vinegar": ["vinegar", "خل"],
}
#: Fixed words of compound products, which outrank the base families. The commonest; a catalogue's own are a parameter.
DERIVED_FAMILIES = {
    "chocolate": ["chocolate", "cocoa", "شوكولاته", "شوكولا", "كاكاو", "جالكسي", "kinder", "oreo", "snickers", "twix", "kitkat"],
    "biscuit": ["biscuit", "biscuits", "cookie", "cookies", "wafer", "cracker", "crackers", "بسكويت", "كوكيز", "ويفر"],
    "cake": ["cake", "cakes", "muffin", "croissant", "كيك", "كيكه", "كعك", "مافن", "كرواسون"],
    "pastry": ["pastry", "pastries", "puff", "dough", "عجينه", "عجين", "فطاير", "سمبوسه", "donut", "donuts", "دونات"],
    "icecream": ["icecream", "gelato", "ايس", "بوظه"],
    "powder": ["powder", "بودره", "مسحوق", "مجفف", "مجففه"],
    "cereal": ["cereal", "cereals", "flakes", "oats", "granola", "muesli", "كورن", "فليكس", "شوفان", "جرانولا"],
    "candy": ["candy", "gum", "marshmallow", "lollipop", "حلوى", "حلاوه", "جيلي", "علكه", "مصاص", "مصاصه", "مصاصات"],
    "chips": ["chips", "crisps", "شيبس"],
    "sauce": ["sauce", "ketchup", "mayonnaise", "paste", "puree", "صوص", "صلصه", "كاتشب", "مايونيز", "معجون", "بيوريه"],
    "dessert": ["dessert", "custard", "pudding", "حلا", "مهلبيه", "كاسترد", "بودينج"],
    "prepared": ["curry", "كاري", "dosa", "sandwich", "ساندويتش", "burger", "برجر", "pizza", "بيتزا", "شاورما", "shawarma", "combo", "وجبه", "meal"],
    "soup": ["soup", "شوربه", "شوربات"],
    "jam": ["jam", "marmalade", "مربي"],
    "syrup": ["syrup", "nectar", "cocktail", "smoothie", "shake", "milkshake", "drink", "drinks", "شراب", "مشروب", "مشروبات", "نكتار", "كوكتيل"],
    "soda": ["soda", "cola", "pepsi", "fanta", "sprite", "7up", "صودا", "كولا", "بيبسي", "فانتا", "غازي", "غازيه", "malt", "شعير"],
    "pickle": ["pickle", "pickles", "مخلل", "مخللات", "طرشي"],
    "toy": ["toy", "toys", "لعبه", "keychain", "keyring", "مفاتيح"],
    "care": ["shampoo", "soap", "lotion", "conditioner", "detergent", "شامبو", "صابون", "لوشن", "بلسم", "معطر", "منظف"],
    "houseware": ["steamer", "blender", "thermos", "flask", "jug", "pitcher", "teapot", "غلايه", "قلايه", "ابريق", "جهاز", "ماكينه", "قدر", "ترمس"],
}
#: Fixed words of fresh fruit and vegetables, the lowest tier.
PRODUCE_FAMILIES = {
    "tomato": ["tomato", "tomatoes", "طماطم", "طماط", "بندوره"],
    "potato": ["potato", "potatoes", "بطاطس", "بطاطا"],
    "onion": ["onion", "onions", "بصل"],
    "garlic": ["garlic", "ثوم"],
    "cucumber": ["cucumber", "cucumbers", "خيار"],
    "carrot": ["carrot", "carrots", "جزر"],
    "lettuce": ["lettuce", "خس"],
    "zucchini": ["zucchini", "courgette", "كوسه"],
    "eggplant": ["eggplant", "aubergine", "باذنجان"],
    "cabbage": ["cabbage", "ملفوف", "كرنب"],
    "cauliflower": ["cauliflower", "broccoli", "قرنبيط", "بروكلي"],
    "spinach": ["spinach", "سبانخ"],
    "okra": ["okra", "باميه"],
    "corn": ["corn", "ذره"],
    "lemon": ["lemon", "lemons", "ليمون"],
    "strawberry": ["strawberry", "strawberries", "فراوله"],
    "banana": ["banana", "bananas", "موز"],
    "apple": ["apple", "apples", "تفاح", "تفاحه"],
    "orange": ["برتقال"],
    "grapes": ["grape", "grapes", "عنب"],
    "mango": ["mango", "مانجو", "مانجا"],
    "watermelon": ["watermelon", "بطيخ", "حبحب"],
    "pineapple": ["pineapple", "اناناس"],
    "peach": ["peach", "خوخ"],
    "apricot": ["apricot", "مشمش"],
    "kiwi": ["kiwi", "كيوي"],
    "pomegranate": ["pomegranate", "رمان"],
    "guava": ["guava", "جوافه"],
}
#: Fixed words of forms.
PRODUCT_TYPES = {
    "nuggets": ["nugget", "nuggets", "ناجتس", "ناغتس", "نجتس", "نجت"],
    "burger": ["burger", "burgers", "hamburger", "برجر", "برغر", "همبرجر", "هامبرجر", "همبرغر"],
    "sausage": ["sausage", "sausages", "frankfurter", "hotdog", "سجق", "سوسيس", "نقانق"],
    "roll": ["roll", "rolls", "رول", "رولات"],
    "mince": ["mince", "minced", "مفروم", "مفرومه"],
    "fillet": ["fillet", "fillets", "filet", "فيليه", "فيليت"],
    "breast": ["breast", "breasts", "صدر", "صدور"],
    "strips": ["strip", "strips", "ستربس", "شرائح"],
    "wings": ["wing", "wings", "جناح", "اجنحه", "جوانح"],
    "kofta": ["kofta", "kufta", "kabab", "kebab", "كفته", "كباب"],
    "luncheon": ["luncheon", "mortadella", "لانشون", "مرتديلا"],
}
#: Fixed source categories that stand for exactly one family.
CATEGORY_FAMILY = {
    "eggs": "eggs",
    "rice": "rice",
    "water": "water",
    "juices-drinks": "juice",
    "oil-ghee": "oil",
    "sugar-sweetener": "sugar",
    "pasta-noodles": "pasta",
    "bread-buns": "bread",
    "biscuits": "biscuit",
    "chocolates-candies": "chocolate",
    "yogurt-labneh": "yogurt",
    "butter-margarine": "butter",
    "fresh-chicken-poultry": "chicken",
    "frozen-chicken-poultry": "chicken",
    "meat-fresh-chilled": "meat",
    "fresh-fish": "fish",
    "frozen-fish": "fish",
    "cereals-bars": "cereal",
}


def word_map(lexicon: dict[str, list[str]]) -> Column:
    return F.create_map(*[F.lit(x) for name, words in lexicon.items() for w in words for x in (w, name)])


def first_in(ws: Column, lexicon: dict[str, list[str]]) -> Column:
    """What the earliest word of a lexicon stands for; null without one. The lexicon is a table of words by name."""
    m = word_map(lexicon)
    return F.get(F.filter(F.transform(ws, lambda w: F.try_element_at(m, w)), lambda x: x.isNotNull()), 0)


def unflavoured(ws: Column) -> Column:
    """The words that no flavour marker stands beside."""
    from shelfwise.functions.text import FLAVOR_AFTER, FLAVOR_BEFORE, strings

    marks = strings(FLAVOR_BEFORE + FLAVOR_AFTER)
    beside = lambda w: F.coalesce(F.array_contains(marks, w), F.lit(False))
    alone = F.transform(ws, lambda w, i: F.when(~beside(F.get(ws, i - 1)) & ~beside(F.get(ws, i + 1)), w))
    return F.filter(alone, lambda w: w.isNotNull())


def family(ws: Column, derived: dict[str, list[str]] | None = None, base: dict[str, list[str]] | None = None, produce: dict[str, list[str]] | None = None) -> Column:
    """The family of canonical words: a word of a compound product outranks a base word, a base word outranks produce.

    Within a tier the earliest word decides; a produce word beside a flavour marker names a flavour, not a product. The
    tables are parameters, as they grow with the catalogue.
    """
    derived = DERIVED_FAMILIES if derived is None else derived
    produce = PRODUCE_FAMILIES if produce is None else produce
    tiers = [first_in(ws, t) for t in (derived, BASE_FAMILIES if base is None else base) if t]
    if produce:
        tiers.append(first_in(unflavoured(ws), produce))
    return F.coalesce(*tiers)


def product_type(ws: Column) -> Column:
    return first_in(ws, PRODUCT_TYPES)


def category_family(category: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in CATEGORY_FAMILY.items() for x in kv])
    return F.try_element_at(m, F.lower(F.coalesce(category, F.lit(""))))


def offer_family(ws: Column, category: Column, **tables) -> Column:
    """The name's family, or else the category's."""
    return F.coalesce(family(ws, **tables), category_family(category))
