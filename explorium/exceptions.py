"""What can go wrong. All but the warning derive from ``ExplorationError``."""


class ExplorationError(Exception):
    """A fault of the set-up: it ends the job instead of marking a run."""


class CaseError(ExplorationError):
    """A run that can't be done with its parameters; it is marked and the others go on."""


class OutcomeError(ExplorationError):
    """An outcome of the wrong type."""


class ParallelError(ExplorationError):
    """Runs failed on the cluster."""


class BoxError(ExplorationError):
    """A step that a box doesn't allow."""


class ExplorationWarning(UserWarning):
    """Something is missing that a run can do without."""
