"""What operators raise."""


class ValidationError(ValueError):
    """Lists every problem of an operator's options at once."""

    def __init__(self, operator: str, problems: list[str]) -> None:
        self.problems = list(problems)
        super().__init__(f"{operator}: " + "; ".join(self.problems))


class UnsupportedOperation(NotImplementedError):
    """The table format at hand has no such command."""
