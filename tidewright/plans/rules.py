"""The rules that the registered queries score with."""

from tidewright.functions.scoring import Rules

#: Rules over terms that occur in the driver's documents. Made up; they have the shape of a real set.
RULES = Rules(
    skills={
        "license": 10, "version": 9, "rights reserved": 9, "the": 8, "ing": 7, "trash": 6, "clown": 6, "public license": 5,
        "software": 5, "permission": 4, "mit license": 4, "password": 4,
    },
    flags={"stupid": -15, "moron": -12, "scum": -10, "worthless": -20, "copyright": -4, "idiot": -5},
    domains={"Apache/MIT": 8, "General Public License": 8, "Open, Source": 7, "work": 7, "of": 6},
    years=7, locations=("Bangalore", "Bengaluru", "Remote India"),
)
