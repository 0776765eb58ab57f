"""A test document of our own, with every kind of node, and the white space rule that writes it as it is."""

GARDEN = """<?xml version="1.0"?>
<garden name="north">
  <bed id="b1" soil="loam">
    <plant type="opaque">Sweet pea &amp; bean</plant>
    <rows type="integer">3 4 5</rows>
    <depth type="real">0.25 12.5</depth>
    <!-- thin out in May -->
    <note>water at dawn</note>
  </bed>
  <bed id="b2"/>
  <tool>
    <tool>rake tines</tool>
  </tool>
  <![CDATA[if a < b & c]]>
  <?print now?>
</garden>
"""

#: Counted by hand. Data: 15 stretches of white space between tags, the plant's text, 3 whole numbers, 2 reals, and 5 words.
GARDEN_EVENTS = {"CDATA": 1, "COMMENT": 1, "DATA": 26, "DIRECTIVE": 2, "ELEMENT_OPEN": 9, "ELEMENT_CLOSE": 9}


def two_spaces(node, place):
    """A line for each tag that holds tags, and for each other node with its values; two spaces a level."""
    holds = node.name in ("garden", "bed") or node.name == "tool" and node.depth == 2
    if place == "before_open" or place == "before_close" and holds:
        return "  " * (node.depth - 1)
    if place == "after_close":
        return "\n"
    if place == "after_open":
        return "\n" if holds or node.leaf or node.node_type != "ELEMENT" else None
    return None
