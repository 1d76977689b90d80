"""Source text to elements: type, name, content, line_start, line_end, attributes, children."""

from .tree import Element, convert, element_table, parse

__all__ = ["Element", "convert", "element_table", "parse"]
