"""Files as office programs write them, and a dictionary in place of an analyser."""

import io
import zipfile

from docquarry.functions.morph import Morpheme, Morphology

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def archive(**entries: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(*lines: tuple[str, ...]) -> bytes:
    body = "".join("<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>" for runs in lines)
    return archive(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def pptx(slides: dict[int, str]) -> bytes:
    return archive(**{f"ppt/slides/slide{n}.xml": f"<a:sld {A}><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:sld>" for n, t in slides.items()})


def xlsx(rows: list[list[str]]) -> bytes:
    words = sorted({c for r in rows for c in r})
    shared = "<sst>" + "".join(f"<si><t>{w}</t></si>" for w in words) + "</sst>"
    sheet = "<worksheet><sheetData>" + "".join("<row>" + "".join(f'<c t="s"><v>{words.index(c)}</v></c>' for c in r) + "</row>" for r in rows) + "</sheetData></worksheet>"
    return archive(**{"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet})


class Dictionary:
    """Morphemes of the words that it knows, as ``(form, tag, start in word, length)``."""

    WORDS = {
        "도왔다.": (("돕", "VV", 0, 1), ("았", "EP", 1, 1), ("다", "EF", 2, 1), (".", "SF", 3, 1)),
        "도왔고,": (("돕", "VV", 0, 1), ("았", "EP", 1, 1), ("고", "EC", 2, 1), (",", "SP", 3, 1)),
        "돕다": (("돕", "VV", 0, 1), ("다", "EF", 1, 1)),
        "이웃을": (("이웃", "NNG", 0, 2), ("을", "JKO", 2, 1)),
        "연구소에서": (("연구소", "NNG", 0, 3), ("에서", "JKB", 3, 2)),
        "연구소": (("연구소", "NNG", 0, 3),),
        "합창단에서": (("합창", "NNG", 0, 2), ("단", "XSN", 2, 1), ("에서", "JKB", 3, 2)),
        "합창단": (("합창", "NNG", 0, 2), ("단", "XSN", 2, 1)),
        "오디오북과": (("오디오", "NNG", 0, 3), ("북", "NNG", 3, 1), ("과", "JC", 4, 1)),
        "오디오북": (("오디오", "NNG", 0, 3), ("북", "NNG", 3, 1)),
        "정리한다.": (("정리", "NNG", 0, 2), ("한다", "XSV", 2, 2)),
        "정리함": (("정리", "NNG", 0, 2), ("함", "XSV", 2, 1)),
    }

    def morphemes(self, text):
        out, at = [], 0
        for n, word in enumerate(text.split(" ")):
            out += [Morpheme(f, t, at + a, k, n) for f, t, a, k in self.WORDS.get(word, ())]
            at += len(word) + 1
        return out


def morphology():
    return Morphology(Dictionary())


def analyser_of(model):
    return Dictionary()
