"""Selectors over a tree of the page, as a plain version of the tag machine."""

from html.parser import HTMLParser

from tandem.sources.markup import Tags, fits, steps_of


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def text(self):
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def matches(self, path, root):
        if not fits(path[-1], self.tag, self.attrs):
            return False
        left, node = len(path) - 1, self.parent
        while left and node is not None and node is not root.parent:
            left -= fits(path[left - 1], node.tag, node.attrs)
            node = node.parent
        return not left

    def select(self, selectors):
        return [n for n in self.walk() if any(n.matches(p, self) for p in steps_of(selectors))]

    def first(self, selectors):
        return next(iter(self.select(selectors)), None) if selectors else None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = self.root = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "li" and self.at.tag == "li":
            self.at = self.at.parent
        self.handle_startendtag(tag, attrs)
        if tag not in Tags.VOID:
            self.at = self.at.children[-1]

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html):
    made = _Tree()
    made.feed(html)
    made.close()
    return made.root
