"""Localised UI text, ``dict[lang][key]`` → ``dict.lo[key]`` → ``key``.

The dictionaries are constant maps inside the expression (no join, no
broadcast). Not registered as a query: the test tables carry no UI keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kipmart.functions.text import literal_map

# Lao UI texts by key.
TEXT_LO = {
    "nav.home": "ໜ້າຫຼັກ",
    "nav.shop": "ຮ້ານຄ້າ",
    "nav.about": "ກ່ຽວກັບ",
    "nav.contact": "ຕິດຕໍ່",
    "nav.search": "ຄົ້ນຫາ",
    "nav.account": "ບັນຊີ",
    "nav.cart": "ກະຕ່າ",
    "dd.welcome": "ຍິນດີຕ້ອນຮັບ",
    "dd.login": "ເຂົ້າສູ່ລະບົບ",
    "dd.register": "ສະໝັກສະມາຊິກ",
    "dd.profile": "ໂປຣໄຟລ໌ຂອງຂ້ອຍ",
    "dd.orders": "ລາຍການສັ່ງຊື້",
    "dd.logout": "ອອກຈາກລະບົບ",
    "sb.cats": "ໝວດໝູ່ສິນຄ້າ",
    "sb.all": "ທັງໝົດ",
    "sb.price": "ກັ່ນຕອງລາຄາ",
    "sb.size": "ຂະໜາດ",
    "sb.color": "ສີ",
    "sb.brand": "ແບຣນ",
    "sb.featured": "ສິນຄ້າແນະນຳ",
    "sb.filter": "ກັ່ນຕອງ",
    "tb.sort.default": "ຈັດລຽງປົກກະຕິ",
    "tb.sort.price.asc": "ລາຄາ: ຕ່ຳ → ສູງ",
    "tb.sort.price.desc": "ລາຄາ: ສູງ → ຕ່ຳ",
    "tb.sort.name": "ຊື່: ກ → ຮ",
    "tb.filter": "Filter",
    "card.view": "ເບິ່ງສິນຄ້າ",
    "card.add": "+ ກະຕ່າ",
    "card.add.mob": "+ ໃສ່ກະຕ່າ",
    "card.pre": "📦 Pre-Order",
    "card.pre.mob": "📦 Pre-Order (7-14 ວັນ)",
    "card.label.new": "ສິນຄ້າໃໝ່",
    "card.label.sale": "ລຸດລາຄາ",
    "card.label.pre": "📦 Pre-Order",
    "loading": "ກຳລັງໂຫຼດ...",
    "no.products": "ບໍ່ພົບສິນຄ້າ",
}

# English UI texts by key.
TEXT_EN = {
    "nav.home": "Home",
    "nav.shop": "Shop",
    "nav.about": "About",
    "nav.contact": "Contact",
    "nav.search": "Search",
    "nav.account": "Account",
    "nav.cart": "Cart",
    "dd.welcome": "Welcome",
    "dd.login": "Sign In",
    "dd.register": "Register",
    "dd.profile": "My Profile",
    "dd.orders": "My Orders",
    "dd.logout": "Sign Out",
    "sb.cats": "Categories",
    "sb.all": "All Products",
    "sb.price": "Filter By Price",
    "sb.size": "Size",
    "sb.color": "Color",
    "sb.brand": "Brand",
    "sb.featured": "Featured",
    "sb.filter": "Filter",
    "tb.sort.default": "Default Sorting",
    "tb.sort.price.asc": "Price: Low → High",
    "tb.sort.price.desc": "Price: High → Low",
    "tb.sort.name": "Name: A → Z",
    "tb.filter": "Filter",
    "card.view": "View Item",
    "card.add": "+ Cart",
    "card.add.mob": "+ Add to Cart",
    "card.pre": "📦 Pre-Order",
    "card.pre.mob": "📦 Pre-Order (7-14 days)",
    "card.label.new": "New",
    "card.label.sale": "Sale",
    "card.label.pre": "📦 Pre-Order",
    "loading": "Loading...",
    "no.products": "No products found",
}

TEXTS = {"lo": TEXT_LO, "en": TEXT_EN}
FALLBACK_LANG = "lo"


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def localise(lang: Column, key: Column) -> Column:
    """Text for ``key`` in ``lang``; falls back to Lao, then to the key."""
    by_lang = None
    for code, table in TEXTS.items():
        hit = F.try_element_at(literal_map(table), key)
        by_lang = (F.when(lang == code, hit) if by_lang is None
                   else by_lang.when(lang == code, hit))
    first = by_lang.otherwise(F.lit(None).cast("string"))
    lo = F.try_element_at(literal_map(TEXTS[FALLBACK_LANG]), key)
    return F.when(_truthy(first), first).when(_truthy(lo), lo).otherwise(key)
