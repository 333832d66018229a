"""Constant rows beside the tables: texts on which rules fire, and what is expected of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Texts that join the documents, under negative ids.
TEXTS = (
    "The cat ran. The dog sat. The cow ate. A bird sang. Then all slept.",
    "Gray colour in the theatre. A grey color fills the center; we organize and organise it.",
    "We like grey walls, and Honour too. Mr Color came. Colour matters.",
    "It was made. It was done. We ran. We sat. We ate. We slept. It is kept.",
    "Furthermore, we left. It rained. Moreover, we sang. Notably, all came.",
    "One — two\n\nThree — four — five\n— six",
    "A — b.\n\nC — d.",
    "7 cats sat. 1999 was fine. (12 dogs ran.)\n- 3 cups\n| 4 | cells |",
    "Have you ever wondered why? We have.",
    "Stop! Now! Go!",
    "It’s fine.\nHe said \"no\" and 'yes' and \"so\".",
    "Dr. Lee met Mr. Poe at 5 p.m. in St. Ives. J. Smith left early. Why? Nobody knows etc. and so on.",
    "- The first item is here.\n- The second item is here.\n- The third item is here.\nThe end came.",
    "| a | b |\n|---|---|\n| c | d e f |\n\nAfter the table.",
    "The NGOX met. Then (ABCD) and ABCD came; the API too. CHAPTER VII IS OVER. " + "word " * 90,
    "word " * 120 + "\n" + "word " * 40 + "\n\n" + "word " * 10,
    "Write to ann.lee@mail.example.com. Call at 5. Done? 👍🏽 👨‍👩‍👧 ok",
    "Red, green, and blue win. Cats, dogs and birds run. " + "We walk on and on here. " * 11,
    "#one #two @three\n\nPlain text. More text. A bit. So on. And on. Yes so. No no.",
    "A robust plan. We delve into it. You shall pay prior to noon. Please note the rule. It is a vibrant, holistic view.",
    "Experts say it works. There are two ways. Going forward we sell. It was decided that we go. We made a decision.",
    "Prices fell dramatically. We are committed to quality. Start with tea and/or milk on 1/2/2026. In a world where all is new.",
    "You won't believe it. At the end of the day, we win. I hope this helps. It is not just a pen but a friend.",
    "BUY THIS NEW CAR TODAY please. Stop!! It left an indelible mark. It serves as a lamp. The flat boasts a view.",
)
DOCUMENTS = tuple((-k, text, "en", "case") for k, text in enumerate(TEXTS, 1))

#: English rules: code, a text on which it fires, and one on which it does not.
ENGLISH = (
    ("en-ai-vocab", "We delve into tax law.", "We look into tax law."),
    ("en-buzzword", "A robust plan.", "A firm plan."),
    ("en-significance", "It left an indelible mark on me.", "It left a mark on me."),
    ("en-copula-avoid", "It serves as a lamp.", "It is a lamp."),
    ("en-ing-analysis", "Sales rose, highlighting demand for tea.", "Sales rose, highlighting demand\nfor tea"),
    ("en-vague-attribution", "Experts say it works.", "Experts say it works [source: lab]."),
    ("en-media-canned", "It was featured in several papers.", "It was in one paper."),
    ("en-not-just", "It is not just a pen but a friend.", "It is not a pen."),
    ("en-not-x-but-y", "It's not a bug, it's a gift.", "It is a gift."),
    ("en-no-x-no-y", "No fees, no forms, just money.", "No fees and no forms."),
    ("en-summary-opener", "Overall, we won.", "We won overall, then left."),
    ("en-challenges-outlook", "Despite its age the bridge faces storms.", "The bridge is old."),
    ("en-didactic", "It is important to note the time.", "Note the time."),
    ("en-chatbot-residue", "I hope this helps.", "This helps."),
    ("en-cutoff-speculation", "It is not widely documented.", "It is documented."),
    ("en-template-residue", "Dear [Your Name],", "Dear Ann,"),
    ("en-chatbot-markup", "see [Cite: 3] now", "see cite now"),
    ("en-vague-association", "It is widely associated with rain.", "It brings rain."),
    ("en-marketing-has", "The flat boasts a view.", "The flat has a view."),
    ("en-sycophancy", "That is a great question.", "That is a question."),
    ("en-stat-claim", "Sales rose 40%.", "Save 40% off all cups."),
    ("en-superlative", "We are #1 in Berlin.", "We are in Berlin."),
    ("en-establishment-claim", "A clinically proven cream.", "A cream."),
    ("en-testimonial", "“It changed my whole life,” says Jane Doe.", "“It changed my whole life” is a line."),
    ("en-hidden-verb", "We made a decision.", "We decided."),
    ("en-impersonal-passive", "It was decided that we go.", "We decided to go."),
    ("en-inflated-adverb", "Prices fell dramatically.", "Prices fell by half."),
    ("en-corporate-we", "We are committed to quality.", "We test each part."),
    ("en-adjective-stack", "A powerful, intuitive tool.", "A powerful tool."),
    ("en-complex-word", "Call prior to noon.", "Call before noon."),
    ("en-shall", "You shall pay.", "You must pay."),
    ("en-double-negative", "It is not unlikely.", "It is likely."),
    ("en-slash", "Use tea and/or milk.", "Use tea or milk."),
    ("en-please-note", "Please note the rule.", "The rule applies."),
    ("en-there-is", "There are two ways.", "Two ways exist."),
    ("en-metaphor-buzz", "Going forward we sell.", "We sell."),
    ("en-numeric-date", "Due 1/2/2026.", "Due 1 February 2026."),
    ("en-ampersand", "Salt & pepper.", "| Salt & pepper |"),
    ("en-double-space", "End.  Next.", "End. Next."),
    ("en-link-text", "Go [here](https://a.b).", "Go to [the price list](https://a.b)."),
    ("en-all-caps", "BUY THIS NEW CAR TODAY please", "Buy this NEW car"),
    ("en-cliche-open", "In a world where all is new.", "In a town."),
    ("en-journey", "Start your journey.", "Map the customer journey."),
    ("en-moral-close", "At the end of the day, we win.", "At day's end we rest."),
    ("en-clickbait", "You won't believe it.", "You will believe it."),
    ("en-citation-check", "See 10.1000/xyz123.", "See the paper."),
    ("en-dash-spacing", "He — she", "He—she"),
    ("en-emoji-format", "✨ New today", "New today"),
    ("en-bangs", "Stop!!", "Stop!"),
)
#: Persian rules, likewise.
PERSIAN = (
    ("arabic-yeh", "علي رفت", "علی رفت"),
    ("arabic-kaf", "كتاب", "کتاب"),
    ("dash", "خانه — باغ", "۱۰–۲۰"),
    ("hyphen-dash", "خانه - باغ", "خانه‌باغ"),
    ("zwnj-mi", "او می رود", "جام می ناب"),
    ("zwnj-mi-joined", "نمیشود", "نمی‌شود"),
    ("zwnj-ha", "کتاب ها", "کتاب‌ها"),
    ("ezafe-he", "خانه ی ما", "خانه‌ی ما"),
    ("neg-contrast", "ما فروشگاه نیستیم، خانواده هستیم", "اگر فروشگاه نیستیم، خانواده هستیم"),
    ("na-contrast", "خانه را دیدم، نه باغ.", "خانه را می‌خواهی، نه باغ؟"),
    ("just-not", "این فقط یک کتاب نیست", "این کتاب نیست"),
    ("not-only", "نه تنها خوب بلکه زیبا", "خوب و زیبا"),
    ("beyond", "فراتر از یک کتاب", "یک کتاب"),
    ("journey", "سفری به دل تاریخ", "سفر به شیراز"),
    ("welcome-world", "به دنیای کتاب خوش آمدید", "به خانه آمدید"),
    ("world-today", "در دنیای امروز", "در دنیای بزرگ"),
    ("unique-exp", "تجربه‌ای بی‌نظیر", "تجربه‌ای خوب"),
    ("we-believe", "ما معتقدیم", "ما رفتیم"),
    ("self-ref", "با ما همراه باشید", "با ما بیایید"),
    ("did-you-know", "آیا می‌دانستید", "آیا رفتید"),
    ("nowadays", "امروزه همه", "امروز همه"),
    ("golden-tip", "نکته طلایی", "نکته خوب"),
    ("admin", "این کتاب می‌گردد", "دنبال کار می‌گردد"),
    ("admin-phrase", "اقدام به خرید نمایید", "خرید کنید"),
    ("inflated-adverb", "فوق‌العاده بود", "خوب بود"),
    ("sycophancy", "سوال خوبی پرسیدید", "سوال پرسیدید"),
    ("heavy-passive", "تصمیم گرفته شد", "تصمیم گرفتیم"),
    ("tanvin-fa", "گاهاً می‌رود", "گاهی می‌رود"),
    ("double-plural", "اخبارها", "اخبار"),
    ("spacing-compound", "بعنوان مثال", "به عنوان مثال"),
    ("heavy-prep", "بر روی میز", "روی میز"),
    ("latin-question", "خوبی?", "خوبی؟"),
    ("clickbait", "باور نمی‌کنید", "باور کنید"),
    ("demo-word", "متن آزمایشی", "متن نهایی"),
    ("bang-bang", "سلام!!", "سلام!"),
    ("ellipsis", "سلام…", "سلام."),
    ("latin-quote", "\"سلام\"", "«سلام»"),
    ("latin-comma", "سلام, خوبی", "سلام، خوبی"),
    ("latin-semicolon", "سلام; خوبی", "سلام؛ خوبی"),
    ("serial-comma", "سیب، انار، و انگور", "سیب، انار و انگور"),
    ("space-before-punct", "سلام ، خوبی", "سلام، خوبی"),
    ("latin-digit", "کتاب 5", "کتاب ۵"),
    ("lexicon", "یک تجربه بی‌نظیر", "یک تجربه خوب"),
)
#: Persian texts, with the document rules that fire, in order of code.
PERSIAN_DOCUMENTS = (
    ("این کتاب را دیدم و آن را خریدم.", "ra-chain"),
    ("می‌گوید که او که آمد گفت که خوب شد.", "ke-chain"),
    ("اگه خونه بودم خوب است.", "mixed-register"),
    ("آیا خوب بود؟ بله.", "rhetorical-open"),
    ("خودت بیا و ببین.", "address"),
    ("به تو گفتم.", "address"),
    ("تو خونه بمان.", ""),
    ("سلام! خوبی! بیا!", "address,bangs"),
    ("او رفت. او آمد. او ماند. کسی نبود.", "same-opening"),
    ("جمع‌بندی\nکتاب خوب بود.", "final-word"),
    ("✨ کتاب\n✨ دفتر", "emoji,emoji-bullet"),
    ("plain latin", ""),
)
#: Words with their syllables.
SYLLABLES = (
    "table 2, radio 3, every 2, people 2, lately 2, jumped 1, wanted 2, watches 2, easier 3, b2b 1, realism 3, didn't 2, isn't 2, café 2, naïve 2, résumé 2, well-being 3, makes 1, "
    "tables 2, premium 3, actual 3, don't 1, played 1, centre 2, awareness 3, management 3, couldn't 2, media 3, video 3, e-mail 2, prism 2, hour 1, experiences 5, quiet 2, careful 2"
)
#: Sentences with the comma lists that end in them: whether serial, and their items.
LISTS = (
    ("We sell tea, coffee, and milk.", True, 3),
    ("We sell tea, coffee and milk.", False, 3),
    ("Bring pens, paper, ink, and glue now.", True, 4),
    ("We sell tea and milk.", None, None),
    ("In June, we sold tea and milk.", None, None),
    ("If it rains, we stay and read.", None, None),
)
#: Resource files with the units that they hold.
FILES = (
    ("a.json", '{"a": {"b": "x"}, "@a": "no", "c": ["y"]}', (("a.b", "x"), ("c[0]", "y"))),
    ("a.po", 'msgctxt "m"\nmsgid "Open"\nmsgstr "Op"\n"en"\n\nmsgid "Plain"\nmsgstr ""\n\nmsgid "سلام"\nmsgstr ""\n', (("m|Open", "Open"), ("سلام", "سلام"))),
    ("strings.xml", '<resources><string name="t">It &amp; b</string><string name="u" translatable="false">x</string></resources>', (("t", "It & b"),)),
    ("a.strings", '/* "x" = "y"; */\n"k" = "v";', (("k", "v"),)),
)


def quoted(value: str | int | float | bool | None) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).upper() if isinstance(value, bool) else str(value)


def values(rows, columns: str) -> str:
    """Rows as a SQL relation ``t``."""
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, row)) + ')' for row in rows)}) t({columns})"


def with_cases(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(list(DOCUMENTS), "doc_id long, text string, lang string, source string"))


DOCS_SQL = f"docs AS (SELECT doc_id, text, lang, source FROM documents UNION ALL SELECT * FROM {values(DOCUMENTS, 'doc_id, text, lang, source')})"
