"""Writing figures."""

from .plans.render import fig_to_base64_png, save_fig

__all__ = ["fig_to_base64_png", "save_fig"]
