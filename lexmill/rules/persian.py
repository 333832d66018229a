"""Persian pattern rules and word lists."""

from __future__ import annotations

import re

from .model import ERROR, WARNING, PatternRule

# ---- Fixed values: character classes. ----
FA = "\u0600-\u06FF\uFB50-\uFDFF\uFE70-\uFEFE"
LETTERS = "\u0620-\u065F\u066E-\u06D3\u06D5-\u06EF\u06FA-\u06FF\uFB50-\uFDFF\uFE70-\uFEFE"
ZWNJ = "\u200c"
_W = f"[{FA}{ZWNJ}]"
_L = f"[{LETTERS}]"
_LZ = f"[{LETTERS}{ZWNJ}]"
_BLOCK = r"\x{E001}"
_TOKEN = rf"[^\s.!؟?؛;،,…»)|{_BLOCK}]+"
_EQDAM = r"(?:ب?کنید|ب?کنین|ب?نمایید|نمایند|نماید|نماییم|ب?فرمایید|شود|گردد)"

# ---- Fixed values: words. ----
PURPOSE_NOUNS = """اطلاع اطلاعات آگاهی خرید ثبت ثبت‌نام استفاده دریافت انجام تهیه رفاه سهولت ارسال پرداخت بررسی کسب رفع
تسریع تکمیل مشاهده پیگیری ورود عضویت شرکت حفظ جلوگیری آشنایی تأمین تامین ارائه رزرو سفارش تماس همکاری استعلام ارتقا ارتقای
افزایش کاهش بهبود رعایت حضور اخذ صدور تمدید فعال‌سازی دانلود راهنمایی کمک حمایت ایجاد توسعه تحقق نیل رضایت اطمینان
برخورداری بهره‌مندی واریز بازگشت تحویل نصب راه‌اندازی تنظیم ویرایش حذف لغو انصراف بازیابی مطالعه دسترسی پشتیبانی""".split()
LEXICON = {
    "big-adjective": ["بی‌نظیر", "بی نظیر", "منحصربه‌فرد", "منحصر به فرد", "شگفت‌انگیز", "جادویی", "بی‌همتا", "بی‌رقیب", "استثنایی", "خیره‌کننده", "بهترین", "مرغوب‌ترین", "باکیفیت‌ترین"],
    "hollow-feeling": ["دلنشین", "دل‌انگیز", "به‌یادماندنی", "رؤیایی", "رویایی", "لذت‌بخش"],
    "authenticity": ["اصیل", "اصالت", "ریشه‌دار", "کهن"],
    "worn-metaphor": ["غرق شوید", "کاوش کنید", "جواهرِ", "جواهر ", "گنجینه‌ی", "قلبِ تپنده", "قلب تپنده"],
    "corporate": ["پلتفرم", "اکوسیستم", "راهکار", "ارزش‌آفرینی", "هم‌افزایی", "نوآورانه", "پیشرو", "بهینه‌سازی", "ارتقا"],
    "generic-detail": ["با دقت و عشق", "با عشق و دقت", "با عشق تهیه", "با دقت تهیه", "هزاران مشتری", "مشتریان راضی"],
    "filler-link": ["در واقع", "به طور کلی", "به‌طور کلی", "از سوی دیگر"],
    "worn-invitation": ["همین حالا", "فرصت را از دست ندهید", "تجربه کنید"],
    "collective-feeling": ["دلِ هر ایرانی", "دل هر ایرانی", "همه‌ی ما", "همه ی ما"],
    "collective-address": ["مشتریانِ گرامی", "مشتریان گرامی", "کاربرانِ گرامی", "کاربران گرامی", "مخاطبانِ عزیز", "مخاطبان عزیز", "مشتری گرامی", "مشتریِ گرامی"],
}
JARGON = """کانتنت اینفلوئنسر اینفلوئنسری فیچر آنبوردینگ ترند ترندینگ دیتا تسک پرزنت کانورژن کانورت انگیجمنت ریچ اسکیل دیپلوی
ریلیز بنچمارک پرفورمنس پرسونا فانل سگمنت تارگت اپتیمایز برندینگ مارکتینگ بیزینس استوری‌تلینگ کال‌تواکشن یوزر اینسایت""".split()
_PROMO = r"(?:جامع|کاربردی|نوآورانه|بهینه|حرفه‌ای|منحصر[‌ ]?به[‌ ]?فرد|پیشرفته|هوشمند|بی[‌ ]?نظیر|کارآمد|خلاقانه|قدرتمند)"
_DEMO_NOUNS = r"(?:متن|محصول|قیمت|تصویر|عکس|کالا|آیتم|پست|آگهی|صفحه|سفارش|کاربر|نظر|پیام|عنوان|توضیح|توضیحات|لینک|شماره|آدرس|ایمیل|نام|محتوا|بنر|فایل)"
GAP_VERB = rf"(?<!{_LZ})(?:ن?می[‌ ]\S+|ب?شود|ب?شوند|شد|شدند|ن?کنید|ن?کنند|ن?کند|کرد|کردند|ن?باشد|ن?باشند|دارد|دارند|داشت|بود|بودند|نیست|نیستند|نیستیم|نیستید|هست|است|هستند|هستیم)(?!{_LZ})"
GAP_LIST = rf"^\s*(?:و|یا|ولی|اما|چون|زیرا|که|تا|اگر|اگه|وقتی)(?!{_LZ})"
ANSWERS = ("بله", "آره", "آری", "خیر", "نخیر", "نه", "اصلاً", "اصلا", "هرگز", "ابداً", "ابدا", "البته")
NOT_FIRST = ("تنها", "فقط", "و", "یا", "چندان", "خیلی", "ببخشید")
NOT_ALONE = ("بیشتر", "بیش‌تر", "کمتر", "کم‌تر", "زیادتر", "زودتر", "دیرتر")
#: Dial of words a sentence may have, and other limits.
DIAL_WORDS = {1: 14, 2: 18, 3: 24, 4: 28, 5: 34}


def _contrast() -> str:
    """Both halves in one sentence and in one person: one alternative for each person."""
    gap = r"\s*[،,؛]\s*(?P<gap>[^.!؟?؛\n]{0,60}?)"
    persons = (("یم", "هستیم", "ایم"), ("ند", "هستند", "اند"), ("ید", "هستید", "اید"))
    forms = [rf"نیست{end}{gap}(?:(?<!{_LZ}){whole}|(?<={_L})‌{short})" for end, whole, short in persons]
    forms.append(rf"نیست{gap}(?<!{_LZ})(?:است|هست)")
    return rf"(?<!{_LZ})(?:{'|'.join(forms)})(?!{_LZ})"


# ---- Fixed values: rule patterns. ----
_ROWS = (
    ("arabic-yeh", ERROR, r"[يى]"),
    ("arabic-kaf", ERROR, r"ك"),
    ("dash", ERROR, r"[—–]"),
    ("hyphen-dash", ERROR, rf"(?<=[{LETTERS}»)]) - (?=[{LETTERS}«(])"),
    ("zwnj-mi", WARNING, rf"(?<!{_W})(?:ن?می) (?=[{FA}]{{2,}})"),
    ("zwnj-mi-joined", WARNING, rf"(?<!{_W})(?:ن?می)(?=(?:شه|شود|کنه|کند|کنین|کنید|خوام|خواهم|ره|رود|گه|گوید|دونم|دانم|تونی|توانی|تونین|تونید|پزن|پزند|شن|شوند)(?!{_W}))"),
    ("zwnj-ha", WARNING, rf"(?<={_W}) (?:ها|های|هایی|تر|ترین)(?!{_W})"),
    ("ezafe-he", WARNING, rf"(?<=[{FA}]ه) ی(?!{_W})"),
    ("neg-contrast", ERROR, _contrast()),
    ("na-contrast", WARNING, rf"[،؛,;][ \t]*(?P<at>نه)[ \t]+(?P<tail>{_TOKEN}(?:[ \t]+{_TOKEN}){{0,3}})(?=[ \t]*(?:[.!؟?؛;،,…»)|{_BLOCK}]|$))"),
    ("just-not", ERROR, r"فقط\s+یک\s+[^.،؛]{1,30}\s+نیست"),
    ("not-only", ERROR, r"نه\s+(?:فقط|تنها)[^.]{0,80}بلکه"),
    ("beyond", ERROR, r"فراتر\s+از\s+یک"),
    ("problem-solution", ERROR, r"(?:خسته\s+شده‌?\s?اید|دیگر\s+نگران\s+\S+\s+نباشید|راه[‌\s]?حلِ?\s+(?:شما|ما)ست)"),
    ("journey", ERROR, r"سفری\s+به\s+(?:دلِ?|قلبِ?|دنیای)"),
    ("welcome-world", ERROR, rf"به\s+دنیای\s+[^.؟!?\n]{{1,40}}?خوش[\s‌]*(?:آمدید|آمدی|آمدین|اومدین|اومدی|اومدید)|قدم\s+(?:به|در)\s+دنیای\s+[^.؟!?\n]{{1,30}}?(?:بگذارید|بذارید|بزارید|بگذارین|بذارین|بگذار|بذار|بزار)(?!{_LZ})|وارد\s+دنیای\s+[^.؟!?\n]{{1,30}}?(?:شوید|بشوید|بشید|بشین|بشو|شو)(?!{_LZ})"),
    ("world-today", ERROR, r"(?:در\s+)?دنیای\s+(?:پرشتابِ?\s+)?امروز"),
    ("unique-exp", ERROR, r"تجربه‌?\s?ای\s+(?:بی‌?\s?نظیر|منحصر\s?به\s?فرد|فراموش‌?\s?نشدنی)"),
    ("we-believe", ERROR, r"(?:ما\s+)?(?:معتقدیم|بر\s+این\s+باوریم|افتخار\s+می‌?\s?کنیم)"),
    ("self-ref", ERROR, r"(?:با\s+ما\s+همراه\s+باشید|در\s+این\s+(?:مقاله|متن|نوشته)\s+(?:خواهیم\s+دید|می‌?\s?خوانید))"),
    ("moral-close", WARNING, r"(?:و\s+این\s+یعنی|در\s+نهایت،|به\s+طور\s+خلاصه)"),
    ("did-you-know", ERROR, rf"آیا\s+(?:شما\s+)?می[‌ ]?(?:دانستید|دانستی|دانستین|دونستید|دونستین|دونستی)(?!{_LZ})|(?:^|(?<=[.!؟?]))\s*(?:شما\s+)?می[‌ ]?(?:دونستی|دونستین|دانستید|دانستی)\s+که(?!{_LZ})"),
    ("lets", WARNING, rf"(?:^|(?<=[.!؟?؛:…»]))[ \t]*(?:[-*•>]+[ \t]*)?(?:پس[ \t]+|حالا[ \t]+)?(?P<at>(?:بیایید|بیاین)(?!{_LZ}))"),
    ("nowadays", WARNING, rf"(?<!{_LZ})امروزه(?!{_LZ})|در\s+عصرِ?\s+(?:حاضر|کنونی)(?!{_LZ})"),
    ("no-secret", ERROR, r"بر\s+(?:کسی|هیچ[‌ ]?کس|هیچ\s+کس)\s+پوشیده\s+نیست"),
    ("golden-tip", WARNING, r"نکته(?:[‌ ]?ی|ٔ)?\s+طلایی|نکات\s+طلایی|نکته(?:[‌ ]?ی|ٔ)?\s+(?:مهم|کلیدی)\s+(?:این\s+است|اینجاست|این‌جاست|اینه)\s+که"),
    ("final-word", WARNING, rf"سخنِ?\s+پایانی|کلامِ?\s+آخر(?!{_LZ})"),
    ("hope-helpful", ERROR, r"امیدوار(?:م|یم)[^.؟!?\n]{0,60}?(?:مفید\s+(?:بوده|واقع\s+شده)\s+باش(?:د|ه)|لذت\s+برده\s+باشی(?:د|ن)|به\s+کارتان\s+آمده\s+باشد|به\s+کارتون\s+اومده\s+باشه)"),
    ("admin", ERROR, rf"(?<!{_W})می‌?\s?گرد(?:د|ند)"),
    ("admin", ERROR, rf"(?<!{_W})(?:می‌?\s?باشد|می‌?\s?باشند|گردیده|گردیدند|گردید(?![؀-ۿ‌])|نمایید|خواهد\s+گردید|اقدام\s+به\s+\S+\s+نمایید)"),
    ("admin-phrase", WARNING, rf"(?:لازم\s+به\s+ذکر\s+است|قابل\s+توجه\s+است|شایان\s+ذکر|در\s+راستای|به\s+منظورِ?|علی‌?\s?رغم|کلیه‌?\s?ی|مذکور|(?<!{_LZ})جهتِ?\s+(?:{'|'.join(sorted(PURPOSE_NOUNS, key=len, reverse=True))})ِ?(?!{_L}))"),
    ("admin-phrase", WARNING, rf"(?<!{_LZ})(?:نسبت\s+به\s+(?P<g1>[^.!؟?؛،\n]{{1,40}}?)\s+اقدامِ?(?!{_LZ})|اقدام\s+به\s+(?P<g2>[^.!؟?؛،\n]{{1,40}}?)\s+{_EQDAM}(?!{_LZ})|اقدام\s+{_EQDAM}(?!{_LZ}))"),
    ("admin-phrase", WARNING, rf"(?<!{_LZ})(?:لذا|بدین[\s‌]?ترتیب|حائز\s+اهمیت|فوق[\s‌]?الذکر|به‌منظورِ?|قابل‌توجه\s+است|به‌طور\s+خلاصه)(?!{_LZ})"),
    ("moral-close", WARNING, r"در\s+(?:نهایت|پایان|مجموع)\s+(?:می[‌ ]?توان|باید)\s+گفت|در\s+یک\s+کلام|به\s+طور\s+کلی\s+می[‌ ]?توان\s+گفت"),
    ("inflated-adverb", WARNING, rf"(?<!{_LZ})(?:به[‌ ]?(?:طور|شکل|طرز|نحو)\s+(?:قابل[‌ ]?توجه|چشمگیر|چشم[‌ ]گیر)(?:ی)?|فوق[‌ ]?العاده|عمیقاً|به[‌ ]?شدت)(?!{_LZ})"),
    ("calque", WARNING, rf"شیرجه\s+(?:بزنیم|بزنید|بزن|می[‌ ]?زنیم)|در\s+پایانِ?\s+روز(?!{_LZ})|تغییر[‌ ]?دهنده(?:‌ی|ی|ٔ)?\s+(?:بازی|قواعدِ?\s+بازی)|(?:در|روی)\s+یک\s+صفحه\s+(?:باشیم|بودن|هستیم)"),
    ("sycophancy", ERROR, r"(?:سؤال|سوال|پرسش)(?:\s+(?:بسیار|خیلی))?\s+(?:خوبی|عالی|جالبی|هوشمندانه‌ای)\s+(?:پرسیدید|پرسیدی|است|بود|کردید)|خوشحالم\s+که\s+(?:این\s+)?(?:سؤال|سوال|پرسش|پرسیدید|پرسیدی)"),
    ("nominal-verb", WARNING, rf"(?<!{_LZ})منجر\s+به\s|صورت\s+(?:پذیرفت|می[‌ ]?پذیرد|گرفت|می[‌ ]?گیرد)(?!{_LZ})|به\s+انجام\s+(?:رساند|رسید|رسانده|می[‌ ]?رسد|برسانیم)|(?<!{_LZ})انجامِ?\s+\S+\s+توسطِ?\s"),
    ("heavy-passive", WARNING, r"تصمیم\s+گرفته\s+شد|(?:مقرر|اعلام)\s+(?:شد|گردید)\s+که"),
    ("corporate-we", WARNING, r"ما\s+در\s+تلاش(?:یم|\s+هستیم)|تیمِ?\s+ما\s+(?:همواره|همیشه|با\s+تمام)|ما\s+همواره\s+(?:در\s+کنار|تلاش)|متعهد\s+(?:هستیم|می[‌ ]?شویم)\s+که"),
    ("adj-stack", WARNING, rf"(?<!{_LZ}){_PROMO}\s*(?:[،,]\s*|\s+و\s+){_PROMO}(?!{_LZ})"),
    ("label-list", WARNING, r"^[ \t]*(?:[-*•]|\d+[.)])[ \t]+\*\*[^*\n]{1,40}?(?:[:：]\*\*|\*\*[ \t]*[:：])"),
    ("tanvin-fa", ERROR, rf"(?<!{_W})(?:گاهاً|گاها|دوماً|سوماً|چهارماً|خواهشاً|ناچاراً|زباناً|جاناً|تلفناً)(?!{_W})"),
    ("double-plural", ERROR, rf"(?<!{_W})(?:اخبار|اساتید|مسائل|حقوق|اسناد|اشخاص)‌?ها(?!{_W})"),
    ("spacing-compound", WARNING, rf"(?<!{_W})(?:بعنوان|بخاطر|بنابر این|اینطور|اینطوری|آنطور|همینطور)(?!{_W})"),
    ("heavy-passive", WARNING, rf"(?:مورد\s+(?:استفاده|بررسی|توجه|تأیید|تایید)\s+قرار\s+(?:گرفت|می‌?\s?گیرد|گرفته)|(?<!{_W})توسطِ?\s)"),
    ("heavy-prep", WARNING, rf"(?<!{_W})(?:بر\s+روی|در\s+رابطه\s+با|درصورتیکه|در\s+صورتی\s?که|ولیکن|مضافاً|کماکان)(?!{_W})"),
    ("latin-question", WARNING, rf"(?<={_L})[ \t]*\?(?![A-Za-z0-9=&])"),
    ("clickbait", ERROR, r"(?:باور\s+نمی‌?\s?کنید|رازِ?\s+\S+\s+که|چیزی\s+که\s+هیچ‌?\s?کس\s+به\s+شما\s+نمی‌?\s?گوید|آخرین\s+فرصت)"),
    ("vague-apology", ERROR, r"(?:هرگونه|هر\s+گونه)\s+(?:ناراحتی|مشکل|اختلال|نارضایتی)[^.]{0,20}(?:احتمالی)?"),
    ("link-here", WARNING, r"\[(?:اینجا|این‌?\s?جا|کلیک\s+کنید)\]"),
    ("demo-word", WARNING, rf"(?<!{_LZ})(?:لورم\s+ایپسوم|[Ll]orem\s+ipsum)|(?<!{_LZ}){_DEMO_NOUNS}(?:ِ|‌ی|‌های|‌ها|های|ها)?\s+(?:نمایشی|آزمایشی|تستی)(?!{_L})|[(]\s*(?:نمایشی|آزمایشی|تستی)\s*[)]"),
    ("bang-bang", ERROR, r"[!！]{2,}"),
    ("ellipsis", WARNING, r"(?:\.\.\.|…)"),
    ("latin-quote", WARNING, rf"\"(?={_L})|(?<={_L})\""),
    ("latin-comma", WARNING, rf"(?<={_L})[ \t]*,(?![0-9])"),
    ("latin-semicolon", WARNING, rf"(?<={_L});"),
    ("serial-comma", WARNING, rf"،[ \t]*(?P<x>[^،,.!؟?؛;\n{_BLOCK}]{{1,40}}?)[ \t]*(?P<at>،)(?=[ \t]*و(?!{_LZ})[ \t]+\S)"),
    ("space-before-punct", WARNING, rf"(?<={_W}) +(?![:;][)(DP])(?:[،؛:؟!]|\.(?!\.))"),
    ("latin-digit", WARNING, rf"(?<={_W}\s)[0-9]+|(?<![0-9])[0-9]+(?=\s{_W})"),
)

# ---- Fixed values: what the tests of matches look for. ----
CONTRAST_EXEMPT = rf"(?<!{_W})(?:اگر|اگه|وقتی|چون|هرچند|گرچه|ولی|اما|ولیکن|با\s+اینکه)(?!{_W})"
TURNING = r"می‌?\s?گرد(?:د|ند)$"
TURNING_BEFORE = (
    rf"(?<!{_LZ})(?:دنبال|دنبالِ|دنبالش|دنبالشان|دنبالم|دنبالت|دورِ|پیِ|گردِ)(?!{_LZ})[^.!؟?؛،\n]{{0,40}}$"
    rf"|(?<!{_LZ})دور(?!{_LZ})\s+[^\s.!؟?؛،][^.!؟?؛،\n]{{0,38}}$|(?<!{_LZ})(?:را|رو)(?!{_LZ})\s+(?:(?!و\s)[^\s.!؟?؛،]+\s+){{0,2}}$|(?<!{_LZ})(?:باز|بر)\s*$"
)
WINE_AFTER = frozenset("ناب گلگون کهنه کهن لعل لعلی ارغوانی صاف خوشگوار انگوری دوساله مستانه".split())
WINE_BEFORE = rf"(?:(?<!{_L})(?:جام|ساغر|پیاله|پیمانه|ساقی|باده|شراب|خم|سبو|سبوی|بوی|رنگ|مستیِ|قدح|صراحی)ِ?|ِ)\s*$"
VERB_ENDS = "مىیدتهن"
VOWEL_MARKS = "".join(map(chr, range(0x64B, 0x656))) + "\u0670"
WORD = rf"[{LETTERS}{ZWNJ}\u066B\u066C\w]+"
SUFFIXES = """ها های هایی هایم هایت هایش هایمان هایتان هایشان هام هات هاش هامون هاتون هاشون هاست ی ای یی ام ات اش مان تان شان
مون تون شون ست است تر ترین اند ایم اید""".split()


SUMMARY_HEADING = r"^\s{0,3}(?:#{1,6}\s*)?(?:\*\*|__)?\s*(?:[0-9۰-۹]+[.)\-]\s*)?جمع[‌ ]?بندی(?:\s+(?:نهایی|کلی))?\s*(?:\*\*|__)?\s*[:：]?\s*(?:\*\*|__)?\s*$"
# ---- Fixed values: forms of address, each a word or the pattern of one. ----
ADDRESS_TO = r"""باهات واست واسَت برایت خودت خودتو خودتم بهت برات ازت
ن?می[\u200c\x20]?(?:کنی|خوای|خواهی|تونی|توانی|دونی|دانی|گی|گویی|شی|شوی|بینی|خری|گیری|زنی|خوری|دی|دهی|یای|آیی|پوشی|فرستی|مونی|مانی|ری|روی|رسی|پرسی|کشی|بری|آری|ذاری|گذاری|پسندی)
ن?می\u200c(?!گسار|خوار|پرست|فروش|شایست)LETTERS{2,}(?<!بایست)ی
(?:ب|ن)?کنی بکنی داری نداری هستی نیستی باشی نباشی بخری بگیری ببینی بدونی بدانی بیای بزنی بخوری بپوشی بفرستی بمونی بمانی بتونی
بتوانی بشی بخوای بخواهی بگی بگویی بذاری بگذاری بزاری بنویسی بپرسی بسازی بچشی بخونی بیاری ببری بشنوی
بخر بیا بزن بگیر ببین بپرس بنویس بچش بپوش برو بمون بفرست بکن بساز بخون بخور بذار بزار بگو بشنو بیار نکن نخر نرو کن بده""".replace(
    "LETTERS", _L
).split()
ADDRESS_SHOMA = r"""شما شماها شماست شمایید برایتان براتون بهتان بهتون ازتان ازتون باهاتون باهاتان خودتان خودتون واستون
ن?می[\u200c\x20]?(?:کنید|کنین|خواهید|خواین|خوایید|خواید|توانید|تونید|تونین|دانید|دونید|دونین|گویید|گید|گین|شید|شین|بینید|بینین|گیرید|گیرین|دهید|دین|زنید|زنین|خورید|خورین|یایید|یاین|آیید|فرستید|فرستین|مانید|مونید|مونین|رید|رین|ذارید|ذارین|گذارید|خرین)
ن?می[\u200c\x20]LETTERS+(?:ید|ین)(?<![اوآ]ید)
(?:ب|ن)?کنید (?:ب|ن)?کنین دارید دارین ندارید ندارین هستید هستین نیستید نیستین باشید باشین نباشید نباشین شوید نشوید بخرید
بخرین بگیرید بگیرین ببینید ببینین بدانید بدونید بدونین بخوانید بخونید بخونین بروید برین بیایید بیاین بزنید بزنین بفرستید بفرستین
بدهید بمانید بمونید بشوید بشید بخورید بخورین بپوشید بپوشین بگذارید بذارید بذارین بزارین بگید بگین بگویید بنویسید بچشید بچشین
بپرسین بفرمایید فرمایید""".replace("LETTERS", _L).split()


def without_marks(word: str) -> str:
    return "".join(c for c in word if c not in VOWEL_MARKS)


#: The test that a match of a code must pass.
_KEEP = {"dash": "dash", "zwnj-mi": "mi", "neg-contrast": "contrast", "admin": "admin", "na-contrast": "no_tail", "serial-comma": "serial", "admin-phrase": "admin_phrase"}

PATTERN_RULES = tuple(PatternRule(code, severity, f"(?m){pattern}", ignore_case=False, by_line=True, raw=False, keep=_KEEP.get(code, "")) for code, severity, pattern in _ROWS)

#: Fixed value: of overlapping word findings on one line the lowest rank stays.
WORD_RANK = {"brand-spelling": 0, "profile-banned": 1, "profile-avoid": 2, "jargon": 3, "demo-word": 4, "lexicon": 5}


def word_pattern(phrase: str, tolerant: bool = False) -> str:
    """A phrase as a word of its own: with its ezafe, or with a suffix behind a half space.

    A tolerant one takes a half space for a space or none, and Arabic letters for Persian ones.
    """
    word = phrase.strip()
    same = {"ِ": "ِ?", ZWNJ: "ِ?[‌ ]?", " ": r"ِ?\s+", "ی": "[یيى]", "ي": "[یيى]", "ى": "[یيى]", "ک": "[کك]", "ك": "[کك]"} if tolerant else {}
    body = "".join(same.get(c) or re.escape(c) for c in word)
    latin_left = "(?<![A-Za-z0-9_])" if re.match("[A-Za-z0-9]", word) else ""
    latin_right = "(?![A-Za-z0-9_])" if re.search("[A-Za-z0-9]$", word) else ""
    return rf"(?<!{_LZ}){latin_left}{body}{latin_right}ِ?(?:(?!{_LZ})|{ZWNJ}(?:{'|'.join(sorted(SUFFIXES, key=len, reverse=True))})(?!{_LZ}))"


def word_rule(code: str, severity: str, phrase: str, tolerant: bool = True, hint: str = "") -> PatternRule:
    return PatternRule(code, severity, word_pattern(phrase, tolerant), ignore_case=False, by_line=True, hint=hint)


def lexicon_rules(allow: tuple[str, ...] = ()) -> tuple[PatternRule, ...]:
    """One rule a category, without the phrases that the profile allows."""
    kept = {w.strip() for w in allow}
    groups = ([p.strip() for p in phrases if p.strip() not in kept] for phrases in LEXICON.values())
    return tuple(PatternRule("lexicon", WARNING, "|".join(map(word_pattern, g)), ignore_case=False, by_line=True) for g in groups if g)


def jargon_rule(allow: tuple[str, ...] = ()) -> PatternRule:
    kept = {w.strip() for w in allow}
    return PatternRule("jargon", WARNING, "|".join(word_pattern(w, True) for w in JARGON if w not in kept), ignore_case=False, by_line=True)
