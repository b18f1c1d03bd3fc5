"""Plans: the cleaning plan (recommend, apply, report) and the analysis chain."""
