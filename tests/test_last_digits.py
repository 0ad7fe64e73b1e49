"""Results that hang on the last digit of a sum."""

from molmill.operators import filters as O
from molmill.operators import geometry as G


def test_equal_stretches_tie(spark):
    """Two bonds of fluorine and phosphorus, radii 0.57 and 1.07: over 1.64 the stretches are equal, over the binary sum 1.6400000000000001 the later bond came first."""
    atoms = spark.createDataFrame([(1, 0, 9, 3.4, 4.0, 0.0), (1, 1, 15, 6.0, 9.0, 5.0), (1, 3, 15, 6.0, 3.0, 7.000000000000001)], "mol_id long, atom_idx long, atomic_num int, x double, y double, z double")
    bonds = spark.createDataFrame([(1, 0, 1, 1.0), (1, 0, 3, 1.0)], "mol_id long, i long, j long, bond_order double")
    got = {(r.atom_idx, r.j): (r.nth, r.excess) for r in G.excess_bonds(atoms, bonds).collect()}
    assert got == {(0, 1): (1, True), (0, 3): (2, False), (1, 1): (1, False), (3, 3): (1, False)}


def test_centres_are_added_in_the_atoms_order(spark):
    """An atom at 4.5 from the centre, whatever the order of the rows: with x added in another order it came nearer."""
    at = [(8.6, 8.0, 5.0), (8.2, 4.0, 2.0), (2.6, 1.0, 5.0), (1.4, 9.0, 8.0)]
    seen = set()
    for order in ((0, 1, 2, 3), (0, 3, 1, 2), (1, 3, 0, 2), (3, 0, 1, 2), (3, 1, 0, 2)):
        frame = spark.createDataFrame([(1, i, *at[i]) for i in order], "mol_id long, atom_idx long, x double, y double, z double").coalesce(1)
        seen.add(tuple(sorted(r.atom_idx for r in O.within_radius(frame, O.centres(frame), "mol_id", 4.5).collect())))
    assert seen == {(0,)}
