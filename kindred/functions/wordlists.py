"""Fixed values that decide results: stop words and character folds."""

# English stop words. Forms with an apostrophe are left out because
# cleaning removes apostrophes before tokens are compared.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off "
    "over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too very "
    "s t can will just don should now d ll m o re ve y "
    "ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn "
    "wasn weren won wouldn"
).split()

# ASCII spellings of characters that do not decompose to one letter.
MULTI_LETTER_FOLDS = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th",
    "Ĳ": "IJ", "ĳ": "ij",
    "—": "--", "…": "...", "™": "(tm)", "®": "(r)", "©": "(c)", "°": "deg",
    "¼": "1/4", "½": "1/2", "¾": "3/4", "±": "+-", "«": "<<", "»": ">>",
    "€": "EUR", "£": "PS",
}

# Single characters with a one-character ASCII spelling.
SINGLE_LETTER_FOLDS = {
    "Ø": "O", "ø": "o", "Ð": "D", "ð": "d", "Đ": "D", "đ": "d", "Ł": "L", "ł": "l",
    "Ħ": "H", "ħ": "h", "ı": "i", "ª": "a", "º": "o", "µ": "u",
    "¹": "1", "²": "2", "³": "3", "×": "x", "÷": "/", "¡": "!", "¿": "?", "¦": "|",
    "·": "*", "•": "*", "¯": "-", "‐": "-", "‑": "-", "–": "-",
    "‘": "'", "’": "'", "′": "'", "´": "'", "“": '"', "”": '"', "″": '"', "¨": '"',
    "¸": ",", " ": " ",
}
