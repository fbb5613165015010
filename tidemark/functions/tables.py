"""The app, domain and label tables that results depend on."""

from __future__ import annotations

# App name -> app id, by category.
APPS: dict[str, dict[str, str]] = {
    "browser": {
        "firefox": "org.mozilla.firefox", "google chrome": "com.google.Chrome", "google-chrome": "com.google.Chrome", "chrome": "com.google.Chrome",
        "chromium": "org.chromium.Chromium", "chromium-browser": "org.chromium.Chromium", "safari": "com.apple.Safari", "arc": "company.thebrowser.Browser",
        "brave browser": "com.brave.Browser", "brave-browser": "com.brave.Browser", "microsoft edge": "com.microsoft.edgemac", "msedge": "com.microsoft.edgemac",
        "vivaldi": "com.vivaldi.Vivaldi", "opera": "com.operasoftware.Opera", "zen browser": "io.github.nicothin.zen",
    },
    "editor": {
        "code": "com.microsoft.VSCode", "visual studio code": "com.microsoft.VSCode", "code - insiders": "com.microsoft.VSCodeInsiders", "cursor": "com.todesktop.cursor",
        "intellij idea": "com.jetbrains.intellij", "idea": "com.jetbrains.intellij", "pycharm": "com.jetbrains.pycharm", "webstorm": "com.jetbrains.webstorm",
        "goland": "com.jetbrains.goland", "clion": "com.jetbrains.clion", "rustrover": "com.jetbrains.rustrover", "sublime text": "com.sublimetext.4",
        "sublime_text": "com.sublimetext.4", "vim": "org.vim.Vim", "gvim": "org.vim.Vim", "neovim": "io.neovim.nvim", "nvim": "io.neovim.nvim",
        "emacs": "org.gnu.emacs", "xcode": "com.apple.dt.Xcode", "android studio": "com.google.android.studio", "zed": "dev.zed.Zed",
    },
    "terminal": {
        "terminal": "com.apple.Terminal", "iterm2": "com.googlecode.iterm2", "iterm": "com.googlecode.iterm2", "alacritty": "org.alacritty", "kitty": "net.kovidgoyal.kitty",
        "wezterm": "org.wezfurlong.wezterm", "wezterm-gui": "org.wezfurlong.wezterm", "gnome-terminal": "org.gnome.Terminal", "konsole": "org.kde.konsole",
        "hyper": "co.zeit.hyper", "ghostty": "com.mitchellh.ghostty", "rio": "io.raphamorim.rio", "warp": "dev.warp.Warp", "tabby": "org.tabby.Tabby",
    },
    "email": {"mail": "com.apple.mail", "thunderbird": "org.mozilla.thunderbird", "outlook": "com.microsoft.Outlook"},
    "chat": {"slack": "com.tinyspeck.slackmacgap", "discord": "com.discordapp.Discord", "microsoft teams": "com.microsoft.teams2", "teams": "com.microsoft.teams2", "messages": "com.apple.MobileSMS"},
    "meeting": {"zoom": "us.zoom.xos", "zoom.us": "us.zoom.xos", "facetime": "com.apple.FaceTime"},
    "docs": {"notes": "com.apple.Notes", "obsidian": "md.obsidian", "notion": "notion.id"},
    "design": {"figma": "com.figma.Desktop"},
    "devtools": {"postman": "com.postmanlabs.mac", "docker desktop": "com.docker.docker"},
    "media": {"spotify": "com.spotify.client"},
    "file_manager": {"finder": "com.apple.finder", "nautilus": "org.gnome.Nautilus", "files": "org.gnome.Nautilus"},
    "utilities": {
        "preview": "com.apple.Preview", "system preferences": "com.apple.systempreferences", "system settings": "com.apple.systempreferences",
        "activity monitor": "com.apple.ActivityMonitor", "1password": "com.1password.1password", "bitwarden": "com.bitwarden.desktop",
    },
    "project_mgmt": {"linear": "com.linear"},
    "lockscreen": {
        "loginwindow": "com.apple.loginwindow", "lockapp.exe": "com.microsoft.LockApp", "logonui.exe": "com.microsoft.LogonUI", "gnome-screensaver": "org.gnome.ScreenSaver",
        "gnome-shell": "org.gnome.Shell", "xdg-desktop-portal-gnome": "org.freedesktop.portal.Desktop", "i3lock": "org.i3wm.i3lock", "swaylock": "org.swaywm.swaylock",
        "xscreensaver": "org.jwz.xscreensaver", "light-locker": "org.freedesktop.light-locker", "slock": "org.suckless.slock",
    },
}

# Domain category -> domains.
DOMAINS: dict[str, tuple[str, ...]] = {
    "search": ("google.com", "bing.com", "duckduckgo.com", "baidu.com", "yahoo.com", "yandex.com"),
    "code_hosting": ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "sourcehut.org"),
    "docs": ("stackoverflow.com", "stackexchange.com", "developer.mozilla.org", "docs.python.org", "docs.rs", "readthedocs.io", "devdocs.io", "man7.org", "cppreference.com", "learn.microsoft.com", "wiki.archlinux.org", "wikipedia.org", "medium.com", "dev.to"),
    "video": ("youtube.com", "vimeo.com", "twitch.tv", "netflix.com"),
    "social": ("twitter.com", "x.com", "facebook.com", "instagram.com", "reddit.com", "linkedin.com", "mastodon.social", "threads.net", "bsky.app"),
    "news": ("news.ycombinator.com", "techcrunch.com", "arstechnica.com", "bbc.com", "cnn.com", "reuters.com", "theverge.com"),
    "email_web": ("gmail.com", "mail.google.com", "outlook.live.com", "outlook.office.com", "protonmail.com", "mail.yahoo.com"),
    "productivity": ("notion.so", "trello.com", "asana.com", "linear.app", "jira.atlassian.com", "confluence.atlassian.com", "airtable.com", "miro.com", "docs.google.com", "sheets.google.com", "slides.google.com", "drive.google.com"),
    "chat": ("slack.com", "discord.com", "teams.microsoft.com", "web.telegram.org", "web.whatsapp.com"),
    "design": ("figma.com", "canva.com", "dribbble.com"),
}

# Weak rules, first match wins: app id, then app category, then domain category.
APP_ID_LABELS = {
    "com.apple.Terminal": "Build", "com.microsoft.VSCode": "Build", "com.jetbrains.intellij": "Build", "com.googlecode.iterm2": "Build",
    "org.mozilla.firefox": "ReadResearch", "com.google.Chrome": "ReadResearch", "com.apple.Safari": "ReadResearch", "com.apple.mail": "Communicate",
    "com.tinyspeck.slackmacgap": "Communicate", "us.zoom.xos": "Meet", "com.apple.Notes": "Write", "com.apple.finder": "BreakIdle",
}
APP_CATEGORY_LABELS = {
    "lockscreen": "BreakIdle", "meeting": "Meet", "chat": "Communicate", "email": "Communicate", "editor": "Build", "terminal": "Build",
    "devtools": "Debug", "docs": "Write", "design": "Write", "media": "BreakIdle", "file_manager": "BreakIdle",
}
DOMAIN_LABELS = {
    "code_hosting": "Build", "email_web": "Communicate", "chat": "Communicate", "social": "BreakIdle", "video": "BreakIdle",
    "news": "ReadResearch", "docs": "ReadResearch", "search": "ReadResearch", "productivity": "Write",
}

# Label v1 -> (mode, subtype) of v2.
V2_LABELS = {
    "Build": ("Produce", "Build"), "Debug": ("Produce", "Debug"), "Write": ("Produce", "Write"), "Review": ("Produce", "Review"),
    "ReadResearch": ("Consume", "ReadResearch"), "Communicate": ("Coordinate", "Communicate"), "Meet": ("Attend", "Meet"), "BreakIdle": ("Idle", "BreakIdle"),
    "Mixed/Unknown": ("Idle", None),
}
# Subtypes that a mode allows.
MODE_SUBTYPES = {
    "Produce": ("Build", "Debug", "Write", "Review", "Analyze", "Plan", "Admin"),
    "Consume": ("ReadResearch", "Learn", "ExploreReference", "Review", "Monitor", "Analyze"),
    "Coordinate": ("Communicate", "Plan", "Admin", "Review"),
    "Attend": ("Meet", "Learn", "Communicate"),
    "Idle": ("BreakIdle",),
}
# Bounds of feature columns.
RANGES = {
    "app_foreground_time_ratio": (0, 1), "app_change_count": (0, None), "app_switch_count_last_5m": (0, None), "hour_of_day": (0, 23), "day_of_week": (0, 6),
    "session_length_so_far": (0, None), "keys_per_min": (0, None), "backspace_ratio": (0, 1), "shortcut_rate": (0, None), "clicks_per_min": (0, None),
    "scroll_events_per_min": (0, None), "mouse_distance": (0, None), "active_seconds_keyboard": (0, 60), "active_seconds_mouse": (0, 60), "active_seconds_any": (0, 60),
    "max_idle_run_seconds": (0, None), "event_density": (0, None), "window_title_bucket": (0, 255), "title_repeat_count_session": (0, None), "keys_per_min_rolling_5": (0, None),
    "keys_per_min_rolling_15": (0, None), "mouse_distance_rolling_5": (0, None), "mouse_distance_rolling_15": (0, None), "app_switch_count_last_15m": (0, None),
}
