"""The nested conditions that the registered queries ask for."""

from __future__ import annotations

from tomeglass.operators.matching import All, Any, Condition, Not, Pattern, Phrase, Prefix, Similar, Word

PHRASES: dict[int, Condition] = {
    0: Phrase("of the"),
    1: Phrase("the of", slop=2),
    2: Any(Phrase("in the", slop=1), Phrase("und der", boost=2.0)),
    3: Phrase("the and the", slop=4),
    4: Word("que la"),
}

WORD_FORMS: dict[int, Condition] = {
    0: Prefix("tion"),
    1: Pattern("*heit"),
    2: Pattern("th?n*"),
    3: Similar("then", edits=1),
    4: Similar("erent", edits=2, boost=3.0),
    5: Similar("de", edits=2, field="title"),
    6: Any(Prefix("Én"), Pattern("?")),
}

NESTED: dict[int, Condition] = {
    0: All(Any(Word("the"), Word("heit", boost=2.0)), Not(Word("of"))),
    1: Any(All(Phrase("of the"), Word("in")), Prefix("erent"), boost=0.5),
    2: All(Any(Word("und"), Word("que")), Any(Word("der"), Word("les"), Similar("nicht", edits=1)), Not(All(Word("die"), Word("das")))),
    3: All(Pattern("th*ing"), Word("the", field="title"), Any(Not(Word("and")), Word("by"))),
    4: Not(Word("the")),
    5: All(All(All(Word("on"), Word("or")), Not(Not(Word("as")))), Any(Phrase("is the", slop=3, boost=4.0), Word("not there"), Word("from"))),
}
