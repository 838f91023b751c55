"""Cleaning HTML by tokens: what isn't on a list of harmless elements and attributes doesn't come out.

A walk over tags, attributes, comments and text writes everything anew: tags of listed elements with listed
attributes in quotes, and text with its angle brackets escaped. So no removal can join two pieces to a new
tag, and cleaning a clean page changes nothing.
"""

from __future__ import annotations

import html
import re

# Elements and attributes that a clean page never has.
ACTIVE_TAGS = "script iframe object embed form input button textarea select option meta link base".split()
# Elements that go with all they hold: up to their end tag as raw text, or with what is nested in them.
RAW_DROPPED = "script iframe noembed noframes noscript xmp".split()
NESTED_DROPPED = "svg math template".split()
# Elements whose content is text up to their end tag.
RAW_KEPT = ["style"]
TEXT_ONLY = "title textarea".split()

# Elements and attributes that may stay.
ALLOWED_TAGS = frozenset(
    """html head body title style main header footer nav section article aside address hgroup h1 h2 h3 h4 h5 h6 p div span br hr wbr pre
    blockquote q cite a b i u s em strong small big sub sup code kbd samp var tt mark ins del dfn abbr acronym time data ruby rb rt rtc rp bdi bdo
    ul ol li dl dt dd menu dir table caption colgroup col thead tbody tfoot tr th td figure figcaption img picture source map area audio video track
    details summary dialog center font strike fieldset legend label optgroup datalist output meter progress""".split()
)
ALLOWED_ATTRIBUTES = frozenset(
    """id class lang dir title name role style hidden tabindex translate href hreflang rel type download target src srcset sizes alt width height
    loading decoding cite datetime value start reversed colspan rowspan headers scope abbr span align valign bgcolor border cellpadding cellspacing
    color face size summary usemap shape coords controls loop muted poster preload kind label srclang media min max low high optimum open for
    charset nowrap noshade rules frame""".split()
)
URL_ATTRIBUTES = frozenset("href src cite poster background".split())
SAFE_SCHEMES = frozenset("http https ftp ftps mailto tel sms cid xmpp".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)?""")
_IGNORED = re.compile(r"[\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_SCHEME = re.compile(r"([^/?#:]*):")


def safe_link(value: str) -> bool:
    """Whether a link has a harmless scheme or none, as a browser reads it: entities decoded, control
    characters and white space left out."""
    found = _SCHEME.match(_IGNORED.sub("", html.unescape(value)))
    return found is None or found[1].lower() in SAFE_SCHEMES


class Cleaner:
    """``clean(page)`` gives the clean page; ``tags``, ``attributes`` and ``links`` count what it took out."""

    def __init__(self, allowed: frozenset[str] = ALLOWED_TAGS, attributes: frozenset[str] = ALLOWED_ATTRIBUTES):
        self.allowed = allowed - set(ACTIVE_TAGS)
        self.named = attributes
        self.tags = self.attributes = self.links = 0

    def _kept(self, tag: str, found: list[tuple[str, str | None]]) -> str:
        out, seen = [f"<{tag}"], set()
        for name, value in found:
            name = name.lower()
            if name in seen:
                continue  # of repeated attributes the first counts
            seen.add(name)
            if name not in self.named and not re.fullmatch(r"aria-[a-z]+", name):
                self.attributes += 1
            elif value is not None and (name in URL_ATTRIBUTES and not safe_link(value) or name == "srcset" and not all(map(safe_link, value.split(",")))):
                self.links += 1
            else:
                out.append(f" {name}" if value is None else ' {}="{}"'.format(name, value.replace('"', "&quot;").replace("<", "&lt;")))
        return "".join(out) + ">"

    def clean(self, page: str) -> str:
        self.tags = self.attributes = self.links = 0
        out: list[str] = []
        at, last_end, deep, within = 0, page.rfind(">"), 0, ""  # within: the dropped element that the walk is in
        while at < len(page):
            mark = page.find("<", at)
            if mark < 0:
                mark = len(page)
            if mark > at and not deep:
                out.append(page[at:mark])
            if mark > last_end:  # no tag can end any more
                if mark < len(page) and not deep:
                    out.append(page[mark:].replace("<", "&lt;"))
                break
            if page.startswith("<!--", mark):
                short = re.compile(r"<!--(?:-?>)").match(page, mark)
                end = re.compile(r"--!?>").search(page, mark + 4)
                at = short.end() if short else end.end() if end else len(page)
                continue
            if page.startswith(("<!", "<?"), mark) or page.startswith("</", mark) and not page[mark + 2 : mark + 3].isalpha():
                at = page.find(">", mark) + 1 or len(page)
                continue
            closing = page.startswith("</", mark)
            name = _NAME.match(page, mark + 1 + closing)
            if not name or ord(page[name.start()]) > 127:
                if not deep:
                    out.append("&lt;")
                at = mark + 1
                continue
            tag, place, found = name[0].lower(), name.end(), []
            while place < len(page) and page[place] != ">":
                a = _ATTRIBUTE.match(page, place)
                if a.end() == place:
                    break
                place = a.end()
                if a[1]:
                    found.append((a[1], next((v for v in (a[2], a[3], a[4]) if v is not None), None)))
            if place >= len(page):  # the tag has no end: it is text
                if not deep:
                    out.append(page[mark:].replace("<", "&lt;"))
                break
            at = place + 1
            if deep:  # in svg, math or a template
                if tag == within:
                    deep += -1 if closing else page[place - 1] != "/"
                elif not closing and tag in RAW_DROPPED + RAW_KEPT:
                    at = self._raw_end(page, tag, at)[1]
                continue
            if closing:
                if tag in self.allowed:
                    out.append(f"</{tag}>")
                continue
            if tag in self.allowed:
                out.append(self._kept(tag, found))
            else:
                self.tags += 1
            if tag in NESTED_DROPPED:
                within, deep = tag, int(page[place - 1] != "/")
            elif tag == "plaintext":
                break
            elif tag in RAW_DROPPED or tag in RAW_KEPT or tag in TEXT_ONLY:
                end, after = self._raw_end(page, tag, at)
                if tag in RAW_KEPT and tag in self.allowed:
                    out.append(page[at:end] + ("" if after > end else f"</{tag}>"))
                elif tag in TEXT_ONLY:
                    out.append(page[at:end].replace("<", "&lt;"))
                if tag in self.allowed and after > end:
                    out.append(f"</{tag}>")
                at = after
        return "".join(out)

    @staticmethod
    def _raw_end(page: str, tag: str, at: int) -> tuple[int, int]:
        """Where the raw content of ``tag`` ends, and where the walk goes on."""
        end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
        return (end.start(), end.end()) if end else (len(page), len(page))
