"""The tag operators: compute, merge, member sets, features, model, label tag and export."""
