"""Theme coding with transparent word lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word forms by theme, and the hits from which a text has the theme.
THEMES: dict[str, tuple[tuple[str, ...], int]] = {
    "war_security": (("מלחמה", "מלחמות", "המלחמה", "חייל", "חיילת", "חיילים", "חיילות", "צבא", "הצבא", "צה\"ל", "לוחם", "לוחמת", "לוחמים", "מדים", "טיל", "טילים", "אזעקה", "אזעקות", "מקלט", "ממ\"ד", "קרב", "קרבות", "נשק", "רובה", "מילואים", "מילואימניק", "פצוע", "פצועים", "חטוף", "חטופה", "חטופים", "בשבי", "עזה", "לבנון", "יחידה", "שכול", "שכולה", "הרוג", "הרוגים", "חללים", "ניצחון", "אויב", "אויבים", "חזית", "פיקוד", "מחבלים", "מחבל", "שבעה באוקטובר"), 1),
    "grief_loss": (("קבר", "קברים", "לוויה", "יזכור", "שכול", "שכולה", "יתום", "יתומה", "אלמנה", "נרצח", "נרצחה", "נרצחו", "נפל בקרב", "נפלו", "הנופלים", "מצבה", "בית קברות", "לזכרו", "לזכרה"), 1),
    "faith_prayer": (("אלוהים", "אלוקים", "ה'", "השם", "הקב\"ה", "בורא", "תפילה", "תפילות", "מתפלל", "מתפללת", "מתפללים", "להתפלל", "אמונה", "ריבונו", "יתברך", "גאולה", "ישועה", "אמן", "בס\"ד", "תהילים", "אבא שבשמיים", "בשם השם", "רבונו", "קדוש", "שכינה"), 2),
    "hope_resilience": (("יהיה טוב", "תקווה", "ננצח", "נתגבר", "ביחד", "נחזור", "יחזרו", "לטובה", "נעבור", "חזקים", "לא נוותר", "נשרוד", "נקום", "הכל לטובה", "עוד יהיה", "נפרח"), 2),
    "nation_home": (("ארץ ישראל", "עם ישראל", "מדינה", "המדינה", "ירושלים", "מולדת", "מולדתי", "דגל", "הדגל", "ישראל", "הארץ הזאת", "ארצי", "עמי", "ציון"), 2),
    "romance_heartbreak": (("אהבה", "האהבה", "אהבתי", "אהבת", "אוהב", "אוהבת", "מאמי", "נשיקה", "נשיקות", "פרידה", "נפרדנו", "עזבת", "עזבתי", "הלכת", "בגדת", "בוגד", "בוגדת", "נשבר", "נשברתי", "נשברת", "שבור", "שבורה", "הלב שלי", "ליבי", "מתגעגע", "מתגעגעת", "געגוע", "געגועים", "אקס"), 3),
    "party_hedonism": (("מסיבה", "מסיבות", "לרקוד", "רוקד", "רוקדת", "רוקדים", "שותה", "שותים", "לשתות", "שתיתי", "משתכר", "משתכרת", "שיכור", "שיכורה", "טקילה", "וודקה", "ערק", "רום", "מועדון", "וויסקי", "ויסקי", "שמפניה", "צ'ייסרים", "צ׳ייסר", "בקבוק"), 2),
}
# Fixed value: letters that may be joined to the front of a word, up to two.
JOINED = "[והבכלמש]{0,2}"


def theme_regex(words: tuple[str, ...], joined: str = JOINED, letters: str = r"\u0590-\u05FF") -> str:
    """A whole word of the list, longer forms first, perhaps behind joined letters, with none of `letters` on either side."""
    forms = "|".join(re.escape(w).replace('"', '\\"') for w in sorted(words, key=len, reverse=True))
    return f"(?<![{letters}]){joined}(?:{forms})(?![{letters}])"


def hits(text: Column, words: tuple[str, ...], joined: str = JOINED, letters: str = r"\u0590-\u05FF") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(theme_regex(words, joined, letters))), F.lit(0)).cast("long")


def code_themes(
    texts: DataFrame, themes: dict[str, tuple[tuple[str, ...], int]] = THEMES, text: str = "text", joined: str = JOINED, letters: str = r"\u0590-\u05FF",
) -> DataFrame:
    """texts with <theme>_hits and the 0/1 flag <theme> of each theme, on the text as it is; a null text has no hits."""
    out = texts.withColumns({f"{k}_hits": hits(F.col(text), w, joined, letters) for k, (w, _) in themes.items()})
    return out.withColumns({k: (F.col(f"{k}_hits") >= least).cast("int") for k, (_, least) in themes.items()})
