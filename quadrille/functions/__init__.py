"""Column functions on boards, sections and sets of rotations, and the geometry they come from."""
